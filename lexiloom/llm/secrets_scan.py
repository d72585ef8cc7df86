"""Operator 8: secret scan by keyword automaton, anchored patterns and checksums.

Aho-Corasick automata read each text, one as it is and one in lower case, and stop at
the keywords of RULES.
Only there a rule's regular expression is matched, anchored at the keyword, and a
match counts only if its embedded check passes: the CRC-32 that GitHub and npm
tokens end with, the JSON header of a web token, the base64 body of a private key,
or, for assigned values, enough entropy. One narrow pass, no shuffle.

Keywords are found in any case and, where they have two words, joined by "_", "-" or
nothing; case matters where a rule says so. Assigned values may lack quotes; then they
end at white space, or at a character that values like keys and tokens don't hold. A
value has SHORTEST to LONGEST characters (longer ones are data, as embedded files are),
stands at most 32 characters of name and 8 of white space on either side of the sign
behind its keyword, and isn't empty of digits.

Result: (doc_id, kind, start, stop, value_hash, checked), one row for each finding;
start and stop count code points, value_hash is the xxh64 of the secret so that the
result doesn't leak it, checked is true where an embedded CRC-32 proves the secret's
form; the header of a web token and the body of a key are looked at, but prove nothing.

Defined cases: null or empty text: no findings. Null doc_id: findings carry null.
Repeated rows repeat their findings. Of matches at overlapping keywords of one rule
the same value counts once; different rules may report one place, in the order of
RULES. Texts of any length are scanned whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import arrow
from lexiloom.llm.textkernel import chunks

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: str) -> str:
    """CRC-32 of body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def _crc_ok(value: str) -> bool:
    body = value.rpartition("_")[2]
    return crc_suffix(body[:-6]) == body[-6:]


def _jwt_ok(value: str) -> bool:
    head = value.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _key_ok(value: str) -> bool:
    body = "".join(x for x in value.split("\n")[1:-1] if ":" not in x).replace(" ", "").replace("\r", "")
    try:
        return len(base64.b64decode(body, validate=True)) >= 32
    except (binascii.Error, ValueError):
        return False


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _varied(value: str) -> bool:
    return entropy(value) >= 2.8 and any(c.isdigit() for c in value)


class Rule(NamedTuple):
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    check: Callable[[str], bool] | None
    proves: bool  # whether the check is a CRC
    cased: bool = True


#: Characters of an assigned value.
SHORTEST, LONGEST = 16, 4096
_EDGE = r"(?![A-Za-z0-9_])"
RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})" + _EDGE), _crc_ok, True),
    Rule("npm_token", ("npm_",), re.compile(r"(npm_[A-Za-z0-9]{36})" + _EDGE), _crc_ok, True),
    Rule("aws_access_key", ("AKIA", "ASIA"), re.compile(r"(A[KS]IA[A-Z2-7]{16})" + _EDGE), None, False),
    Rule("google_api_key", ("AIza",), re.compile(r"(AIza[A-Za-z0-9_\-]{35})(?![A-Za-z0-9_\-])"), None, False),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"(xox[bpars]-[0-9A-Za-z\-]{20,})"), None, False),
    Rule("stripe_key", ("sk_live_", "rk_live_"), re.compile(r"([sr]k_live_[0-9A-Za-z]{24,})"), None, False),
    Rule("json_web_token", ("eyJ",), re.compile(r"(eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{16,})", re.ASCII), _jwt_ok, False),
    Rule("private_key", ("-----BEGIN ",), re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\r?\n[A-Za-z0-9+/=\s:,\-]*?\n-----END [A-Z ]{0,20}PRIVATE KEY-----)"), _key_ok, False),
    Rule(
        "assigned_secret",
        ("token", "secret", "password", "passwd", *(f"{word}{joiner}key" for word in ("api", "access", "private", "auth") for joiner in ("", "_", "-"))),
        re.compile(r"[a-z_\-]{3,12}[\w.\-]{0,32}[\"']?\s{0,8}(?:=>|:=|=|:)\s{0,8}(?:[\"'](?=[^\"'\s]{%d,%d}[\"'])([^\"'\s]+)|([A-Za-z0-9_\-+/=.~]{%d,%d})(?![A-Za-z0-9_\-+/=.~(\[]))" % (SHORTEST, LONGEST, SHORTEST, LONGEST), re.ASCII | re.IGNORECASE),
        _varied,
        False,
        False,
    ),
)


@lru_cache(maxsize=2)
def automaton(cased: bool) -> ahocorasick.Automaton:
    words: dict[str, set[int]] = {}
    for i, rule in enumerate(RULES):
        for word in rule.keywords if rule.cased == cased else ():
            words.setdefault(word, set()).add(i)
    out = ahocorasick.Automaton()
    for word, rules in words.items():
        out.add_word(word, (len(word), tuple(sorted(rules))))
    out.make_automaton()
    return out


def folded(text: str) -> str:
    """text in lower case, code point by code point: as long as text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _accept(rule: Rule, text: str, at: int) -> tuple[int, int] | None:
    if rule.cased and at and (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] == "_")):
        return None
    found = rule.pattern.match(text, at)
    if not found or (rule.check and not rule.check(found[found.lastindex])):
        return None
    return found.span(found.lastindex)


def scan(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, stop, hash, checked) of every secret, in order."""
    out = {}
    for cased in (True, False):
        for end, (size, rules) in automaton(cased).iter(text if cased else folded(text)):
            for i in rules:
                span = _accept(RULES[i], text, end - size + 1)
                if span:
                    out[(i, *span)] = None
    rows = sorted(out, key=lambda x: (x[1], x[2], x[0]))
    return [(RULES[i].kind, a, b, xxhash.xxh64_intdigest(text[a:b]) - (1 << 63), RULES[i].proves) for i, a, b in rows]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        rows = [(ids[lo + j].as_py(), *found) for lo, _, texts in chunks(batch.column(1)) for j, t in enumerate(texts) for found in scan(t)]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        names = ["doc_id", "kind", "start", "stop", "value_hash", "checked"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)


def secrets(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow(docs, _run, "doc_id bigint, kind string, start bigint, stop bigint, value_hash bigint, checked boolean")
