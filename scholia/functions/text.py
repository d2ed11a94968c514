"""Scalar text functions as Column builders; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section kinds by sec-type, then by the first phrase that a title holds.
SECTION_TYPES = {
    "intro": "Introduction", "introduction": "Introduction", "background": "Background", "materials|methods": "Methods", "methods": "Methods",
    "materials": "Methods", "results": "Results", "results|discussion": "Results", "discussion": "Discussion", "conclusions": "Conclusion",
    "supplementary-material": "Supplementary", "abbreviations": "Other", "acknowledgments": "Acknowledgements", "acknowledgements": "Acknowledgements", "coi-statement": "Acknowledgements",
}
SECTION_TITLES = (
    ("materials and methods", "Methods"), ("methods and materials", "Methods"), ("experimental procedure", "Methods"), ("methodology", "Methods"), ("method", "Methods"),
    ("statistical analysis", "Methods"), ("data analysis", "Methods"), ("study design", "Methods"), ("participants", "Methods"), ("subjects", "Methods"), ("animals", "Methods"),
    ("results and discussion", "Results"), ("result", "Results"), ("findings", "Results"),
    ("limitation", "Limitations"), ("future direction", "Limitations"), ("conclusion", "Conclusion"), ("summary", "Conclusion"),
    ("discussion", "Discussion"), ("interpretation", "Discussion"), ("introduction", "Introduction"), ("background", "Background"), ("related work", "Background"),
    ("acknowledg", "Acknowledgements"), ("supplementary", "Supplementary"), ("supporting information", "Supplementary"), ("data availability", "Supplementary"),
    ("author contribution", "Acknowledgements"), ("conflict of interest", "Acknowledgements"), ("competing interest", "Acknowledgements"), ("funding", "Acknowledgements"), ("abbreviation", "Other"),
)
NON_EVIDENTIAL = ("Acknowledgements", "Supplementary")


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white space."""
    return F.when(F.regexp_like(c, F.lit(r"(?U)\S")), c)


def clean_text(c: Column) -> Column:
    """Text without the debris that dropped citation markers leave: empty brackets, dangling separators, spaces before punctuation."""
    out = F.translate(F.coalesce(c, F.lit("")), " \r\n\t", "    ")
    for pattern, by in (
        ("\\[\\s*[,;–—-]*\\s*\\]", ""),
        ("\\(\\s*[,;–—-]*\\s*\\)", ""),
        ("[,;–—]+(?=\\s*[.,;:!?])", ""),
        ("[,;–—]+\\s*$", ""),
        ("\\s+([,.;:!?])", "$1"),
        ("\\s{2,}", " "),
        ("^\\s+|\\s+$", ""),
    ):
        out = F.regexp_replace(out, "(?U)" + pattern, by)
    return out


def word_count(c: Column) -> Column:
    """Runs of what isn't Unicode white space."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))


def classify_section(sec_type: Column, title: Column) -> Column:
    """The kind of a section: by its type, else by the first listed phrase in its title without leading numbers."""
    kind = F.lower(F.trim(F.coalesce(sec_type, F.lit(""))))
    by_type = F.create_map(*(F.lit(x) for pair in SECTION_TYPES.items() for x in pair))[kind]
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"^[\p{Nd}. ]+", "")
    rule = F.lit("Unknown")
    for phrase, k in reversed(SECTION_TITLES):
        rule = F.when(F.contains(name, F.lit(phrase)), k).otherwise(rule)
    return F.coalesce(by_type, rule)


def is_non_evidential(kind: Column) -> Column:
    """Sections that carry no claim."""
    return kind.isin(*NON_EVIDENTIAL)


def excerpt(c: Column, limit: int) -> Column:
    """The text, cut at the last space within the limit and marked if it is longer."""
    head = F.substring(c, 1, limit)
    last = F.length(head) - F.length(F.substring_index(head, " ", -1))  # characters up to and with the last space
    # the space itself may stand right after the limit
    at = F.when(F.substring(c, limit + 1, 1) == " ", limit + 1).otherwise(last)
    kept = F.when(at > 1, F.substring(c, F.lit(1), at - 1))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.coalesce(kept, head), F.lit(" ...")))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once: an expression that stands in several places is else evaluated in each."""
    return F.element_at(F.transform(F.array(value), of), 1)


def join_distinct(arr: Column, sep: str = "; ") -> Column:
    """Trimmed non-blank items, the first spelling of each whatever its case, in order; null if none."""
    items = F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    ordered = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("l"), i.alias("i"), x.alias("x"))))
    # sorted by spelling, an item is the first of its kind if the one before it differs
    first = _bound(ordered, lambda o: F.filter(F.transform(o, lambda x, i: F.when((i == 0) | (F.get(o, i - 1)["l"] != x["l"]), F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x.isNotNull()))
    return F.nullif(F.array_join(F.transform(F.sort_array(first), lambda x: x["x"]), sep), F.lit(""))


def split_names(c: Column) -> Column:
    """Names of a ``;`` list: trimmed, lower case, longer than a letter, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 1))


def normalise_doi(c: Column) -> Column:
    """A DOI in lower case without resolver or prefix; null unless it starts with ``10.``."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(F.startswith(bare, F.lit("10.")), bare)


def normalise_work_id(c: Column) -> Column:
    """The canonical address of a work id with or without host; null for anything else."""
    number = F.regexp_extract(F.trim(c), r"^(?i:https?://openalex\.org/)?[Ww]([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("https://openalex.org/W"), number))


def title_key(c: Column) -> Column:
    """What makes two titles equal: trimmed, without trailing dots, in lower case."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", ""))


def flexible_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as far as known."""
    return F.when(
        year.isNotNull(),
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.when(month.isNotNull(), F.lpad(day.cast("string"), 2, "0"))),
    )


def full_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, with 1 for a month or day that is missing or out of range."""
    m = F.when(month.between(1, 12), month).otherwise(1)
    d = F.when(day.between(1, 31), day).otherwise(1)
    return F.when(year.isNotNull(), F.format_string("%04d-%02d-%02d", year, m, d))


def inverted_index_text(m: Column) -> Column:
    """A text from word -> positions: words in order of position, gaps and negative positions left out; the later entry wins a place."""
    entries = F.flatten(F.transform(F.map_entries(m), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.sort_array(F.filter(entries, lambda x: x["p"] >= 0))
    last = _bound(ordered, lambda o: F.filter(F.transform(o, lambda x, i: F.when(F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)), x["w"])), lambda w: w.isNotNull()))
    return _bound(last, lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")))


def hard_split(words: Column, target: int = 300, overlap: int = 50, least: int = 30) -> Column:
    """Windows of target words that share overlap words; a last one of fewer than least is left out, unless it is the first."""
    step = max(1, target - overlap)
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (n - s >= least))
    # windows stop at the first that is too short
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(target)), " "))).otherwise(F.array().cast("array<string>"))


def rerank_text(title: Column, authors: Column, journal: Column, institutions: Column, doi: Column, topics: Column, body: Column) -> Column:
    """What a second-stage scorer reads of a work: bounded fields, blanks left out."""
    part = lambda c, n: F.substring(blank_to_null(c), 1, n)
    return F.concat_ws(". ", blank_to_null(title), part(authors, 400), part(journal, 200), part(institutions, 400), part(doi, 150), part(topics, 300), blank_to_null(body))


def unescape(c: Column) -> Column:
    """Text with the five markup entities and numeric ones below 128 decoded; a decoded sign is not decoded again."""
    out = c
    for code, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#34", '"'), ("#60", "<"), ("#62", ">"), ("nbsp", "\u00a0"), ("#38", "&"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{code};"), F.lit(sign))
    return out


#: Latin letters with marks, and what is left of them without.
_MARKED, _BARE = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñšžÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÇÑŠŽ", "aaaaaaeeeeiiiiooooouuuuyycnszAAAAAAEEEEIIIIOOOOOUUUUYCNSZ"


def unmarked(c: Column) -> Column:
    """Text without combining marks, and Latin letters without theirs."""
    return F.regexp_replace(F.translate(c, _MARKED, _BARE), r"\p{Mn}", "")


def fingerprint(c: Column) -> Column:
    """Letters and digits only, in lower case, without marks."""
    return F.regexp_replace(F.lower(unmarked(c)), r"[^\p{L}\p{Nd}]", "")
