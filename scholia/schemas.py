"""Explicit schemas of every table the engine reads or writes; none is inferred."""

from __future__ import annotations

ARTICLES = """article_key string, source_corpus string, source_path string, pmcid string, pmid string, doi string,
title string, journal string, issn_electronic string, issn_print string, publisher string, article_type string,
pub_year int, pub_month int, pub_day int, license_url string, license_text string, authors string, keywords string,
abstract string, abstract_word_count int, is_retracted boolean, has_body boolean, body_word_count int,
section_count int, reference_count int, chunk_count int"""

BLOCK = "struct<kind:string, section_title:string, section_path:string, section_index:int, text:string>"

CHUNKS = """chunk_id string, article_key string, source_corpus string, section_kind string, section_title string,
section_path string, section_index int, chunk_index int, text string, word_count int, title string, pub_year int,
is_retracted boolean"""

ABSTRACTS = """openalex_id string, doi string, title string, abstract string, publication_date string,
publication_year int, pmid string, pmcid string, language string, work_type string, cited_by_count long,
is_oa boolean, best_oa_landing_page_url string, best_oa_pdf_url string, best_oa_license string,
primary_landing_page_url string, primary_pdf_url string, primary_source_name string"""

WORKS = """openalex_id string, title string, abstract string, publication_date string, publication_year int,
pmid string, doi string, authors string, institutions string, journal string, issn string, language string,
type string, cited_by_count int, volume string, issue string, first_page string, last_page string,
topics string, keywords string, is_retracted boolean"""

_NAMED = "struct<display_name:string>"
RAW_WORK = f"""id string, doi string, title string, display_name string, publication_date string, publication_year int,
ids struct<pmid:string>, abstract_inverted_index map<string,array<int>>,
authorships array<struct<author:{_NAMED}, raw_author_name:string, institutions:array<{_NAMED}>>>,
primary_location struct<source:struct<display_name:string, issn_l:string>, raw_source_name:string>,
language string, type string, cited_by_count int,
biblio struct<volume:string, issue:string, first_page:string, last_page:string>,
topics array<{_NAMED}>, keywords array<{_NAMED}>, is_retracted boolean"""

QUESTIONS = "query_id string, query_text string, expect_doi string, expect_openalex_id string, note string, stratum string"
RUNS = "query_id string, hits array<string>, scores array<float>, texts array<string>"

#: What a corpus looks like to the index: one row per article or passage.
INDEXABLE = """id string, article_key string, title string, body string, doi string, pmcid string, pmid string,
issn string, authors string, institutions string, journal string, publisher string, topics string, keywords string,
year int, section string, work_type string, citations long, is_retracted boolean, is_oa boolean"""
