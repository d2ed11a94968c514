"""The small labelled table that the personal-data model is trained on, made by a rule.

Each row is (text, [(kind, start, end)]). Values are drawn for placeholders in the templates
by a seeded generator; templates without a placeholder are ordinary text.
"""

from __future__ import annotations

import random
import re

#: Sentence frames. {x} is a value of kind x; those of {none...} are no personal data.
TEMPLATES = (
    "please write to {email} before friday", "Contact: {email}, or call {phone}.", "my e-mail is {email} and my number is {phone}", "From: <{email}>", "mailto:{email}",
    "reach us on {phone} after nine", "Tel. {phone}", "phone: {phone};", "Fax {phone} / office {phone}", "rufen Sie {phone} an", "appelez le {phone}", "llame al {phone}",
    "the server at {ip} did not answer", "login from {ip}, refused", "ping {ip} and then {ip}", "{ip} - - [10/Oct/2020] GET", "card number {card} was charged", "pay with {card}.", "he read out {card} and hung up",
    'token = "{secret}"', 'let the token = "{secret}" expire', "password: {secret}", "api_key={secret}", "secret {secret} leaked", 'key = "{secret}", region = "west"', "my key is {secret}", "export API_KEY={secret}",
    "Authorization: Bearer {secret}", "the bearer {secret} was revoked", "secret: {secret}", "token: {secret},", '"password": "{secret}"', "use the key {secret} for tests", "aws_secret_access_key = {secret}",
    "IBAN: {iban}", "please transfer to {iban} by monday", "account {iban}, thank you", "SSN: {ssn}", "his social security number is {ssn}.", "ssn {ssn} on file", "e-mail {email} from {ip} with {card}",
)
#: Ordinary text that holds nothing personal, some of it with numbers that look like it.
PLAIN = (
    "The and of that with for this from was are not by.", "La de que el en los del se las por un para con no una.", "Der die und in den von zu das mit sich des auf für ist.", "Le de un et en une il est que dans qui par sur les des.",
    "In 1998 the third edition sold 12,000 copies at 3.50 each.", "version 2.4.1 came out on 2021-03-04, ten days late", "see pages 12-19, chapter 3 and table 4.2", "it costs $19.99 *** or 25% less !!! today",
    "THE LOUD TITLE!! WAS!! ALL!! IN!! CAPITALS!!", "one | two | three | four | five", "a### b*** c$$$ d&&& e%%%", "the sum of 1 2 3 4 5 is 15", "room 101, floor 7, building 12b", "item-17 and part-3a are on shelf x9",
    "http://www.example.com/en/123 is a page", "token of thanks and the key to the city, no secret", "the phone rang, the card was lost, the password forgotten", "Released under the MIT License, version 2.0, 2004.",
    "and/or, he said: \"yes\" (or no); never mind...", "commit {none40}", "fixed in commit {none40} of the main branch", "commit {none12}, merged", "sha256:{none64}", "sha256 {none64}  file.tar.gz", "md5 {none32} ok", "the checksum {none32} is right", "blob {none40} was packed",
    "revision {none40} from 2019", "digest: {none64}", "etag {none32}", "ISBN 978-3-16-148410-0 and ISSN 2049-3630", "order 2021-000123 of 12.03.2021", "a part number like AB-1234-5678", "lat 52.5200, lon 13.4050", "between 1914-1918 and 1939-1945",
    "the class AbstractSingletonProxyFactoryBean2 is long", "see https://example.org/a/b?id=1234567890123&x=1", "score 3:1, time 12:45:10", "UUIDs such as 123e4567-e89b-12d3-a456-426614174000 name rows",
)
#: Countries of account numbers, with the length of what follows the check number.
_COUNTRIES = (("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14), ("BE", 12))


def _values(r: random.Random) -> dict[str, str]:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    card = [int(x) for x in "4" + digits(14)]
    odd = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(card))
    card = "".join(map(str, card)) + str(-odd % 10)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n, more="": "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    country, size = r.choice(_COUNTRIES)
    account = "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZ") if country in ("GB", "NL") and i < 4 else r.choice("0123456789") for i in range(size))
    check = 98 - int("".join(str(int(x, 36)) for x in account + country + "00")) % 97
    iban = f"{country}{check:02d}{account}"
    return {
        "email": r.choice(["{0}.{1}@{2}.{3}", "{0}@{2}.example.{3}", "{0}_{1}@mail{4}.{2}.{3}", "{0}.{4}@mail{4}.example.{3}"]).format(letters(r.randint(2, 9)), letters(r.randint(2, 9)), letters(r.randint(3, 8)), r.choice(["com", "org", "net", "de"]), digits(r.randint(1, 2))),
        "phone": r.choice(["+1 ({0}) {1}-{2}", "+{3} {0} {1} {2}", "+{3}-{0}-{1}{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "0{3} {0}{2}", "{0}.{1}.{2}"]).format(digits(3), digits(3), digits(4), digits(2)),
        "ip": ".".join(str(r.randint(1, 254)) for _ in range(4)),
        "card": r.choice([card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))]),
        "secret": r.choice([hexes(32), hexes(40), hexes(40), hexes(64), "AKIA" + upper(16), mixed(r.randint(24, 48)), "sk-" + mixed(40), "ghp_" + mixed(36), "eyJ" + mixed(24) + "." + mixed(40) + "." + mixed(30, "_-"), mixed(40, "/+")]),
        "iban": r.choice([iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))]),
        "ssn": f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        "none12": hexes(12), "none32": hexes(32), "none40": hexes(40), "none64": hexes(64),
    }


def rows(n: int = 1500, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        parts = [r.choice(PLAIN), r.choice(TEMPLATES), r.choice(PLAIN)]
        for part in parts:
            text += " " if text else ""
            for piece in re.split(r"(\{\w+\})", part):
                if piece[:1] == "{":
                    value = _values(r)[piece[1:-1]]
                    if not piece.startswith("{none"):
                        spans.append((piece[1:-1], len(text), len(text) + len(value)))
                    text += value
                else:
                    text += piece
        out.append((text, spans))
    return out
