"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, plus signs, digits, schemes and cues; from each
of these a small parser expands to the left and right and validates what it has found.

Every kind keeps its own position, so that matches of a kind are leftmost and never overlap, and a parser looks at any
character a bounded number of times: the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BASE = ["email", "ip", "card", "phone"]
ADDED = ["url", "iban", "account", "secret"]
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
#: Cues, each also in capitals and with a capital first letter.
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_SCHEME = re.compile(r"[A-Za-z0-9+.-]")
_URL = re.compile(r"[^\x00-\x20\"'<>()\[\]{}|\\^`]+")
_IBAN = re.compile(r"[Ii][Bb][Aa][Nn][ :.#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"[A-Za-z]+(?: (?:number|nummer|no|nr))?[ .:#]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SECRET = re.compile(r"[A-Za-z_]+[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_.-]{8,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def email(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From an at-sign: the run of local characters before it, not reaching into an earlier match, and the domain after it."""
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    found = _DOMAIN.match(text, at) if start < at else None
    return (start, found.end(), True) if found else None


def quad(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From a digit: four numbers between dots, none above 255. A longer look within the same digits can't succeed where this fails."""
    if found := _QUAD.match(text, at):
        return at, found.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[0].split("."))
    return at, _DIGITS.match(text, at).end(), False


def card(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From a digit: digits with at most one space or hyphen between two, 13 to 19 of them, whose check digit is right."""
    end = _RUN.match(text, at).end()
    digits = re.sub("[ -]", "", text[at:end]) if end - at >= 13 else ""
    return at, end, 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From a plus sign: up to the last digit of the run after it, 9 to 15 digits."""
    found = _PHONE.match(text, at)
    body = found[0].rstrip(" ().-") if found else ""
    if len(body) < 4:
        return None
    return at, at + len(body), 9 <= sum(map(str.isdigit, body)) <= 15


def url(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From :// or www.: the scheme before it, the rest up to white space, quotes or brackets, without signs that end a sentence."""
    start = at
    if text[at] == ":":
        while start > done and _SCHEME.match(text[start - 1]):
            start -= 1
        if start == at or not text[start].isalpha():
            return None
    found = _URL.match(text, at)
    end = at + len(found[0].rstrip(".,;:!?"))
    return start, end, end - at > (3 if text[at] == ":" else 4)


def iban(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    """From the cue: the longest account number after it whose check digits are right."""
    if not (found := _IBAN.match(text, at)):
        return None
    start, end = found.span(1)
    while end - start >= 15:
        if text[end - 1] != " " and mod97(text[start:end].replace(" ", "")):
            return start, end, True
        end -= 1
    return None


def _valued(pattern: re.Pattern) -> Callable:
    def parse(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
        found = pattern.match(text, at)
        return (*found.span(1), found.start(1) >= done) if found else None

    return parse


PARSERS = {"email": email, "ip": quad, "card": card, "phone": phone, "url": url, "iban": iban, "account": _valued(_ACCOUNT), "secret": _valued(_SECRET)}


def anchors() -> ahocorasick.Automaton:
    table = {"@": ["email"], "+": ["phone"], "://": ["url"], "www.": ["url"]} | {d: ["ip", "card"] for d in "0123456789"}
    for cue, kind in CUES.items():
        table |= {form: [kind] for form in (cue, cue.upper(), cue.capitalize())}
    automaton = ahocorasick.Automaton()
    for anchor, kinds in table.items():
        automaton.add_word(anchor, (len(anchor), kinds))
    automaton.make_automaton()
    return automaton


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in order, then start; code points, end exclusive."""
    done = dict.fromkeys(PARSERS, 0)
    found = []
    for last, (length, kinds) in automaton.iter(text):
        at = last - length + 1
        for kind in kinds:
            if at < done[kind]:
                continue
            hit = PARSERS[kind](text, at, done[kind])
            if hit:
                done[kind] = hit[1]
                if hit[2]:
                    found.append((kind, hit[0], hit[1]))
    return sorted(found, key=lambda s: (ORDER[s[0]], s[1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`spans`, an array of (kind, start, end), beside the columns of docs. Null and empty texts have none; a column called spans gives way."""

    def make():
        automaton = anchors()
        names = SPAN.names
        return lambda texts: [[[dict(zip(names, s)) for s in spans(t, automaton)] for t in texts]]

    return common.map_texts(docs, make, [T.StructField("spans", T.ArrayType(SPAN))], text=text, keep=keep)


def masked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Docs with each span of its text replaced by its kind in angle brackets; of spans that overlap the first and longest is taken. Null stays null."""

    def make():
        automaton = anchors()

        def mask(one: str) -> str:
            out, at = [], 0
            for kind, a, b in sorted(spans(one, automaton), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [one[at:a], f"<{kind}>"]
                    at = b
            return "".join([*out, one[at:]])

        return lambda texts: [[mask(t) for t in texts]]

    done = common.map_texts(docs, make, [T.StructField("__masked", T.StringType())], text=text)
    return done.select(*[F.when(common.quoted(c).isNotNull(), F.col("__masked")).alias(c) if c == text else common.quoted(c) for c in docs.columns])


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find(common.table(spark, folder, "documents"), keep=["doc_id"])
    joined = lambda chosen: F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(number, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
