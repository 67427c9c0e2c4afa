"""Secret scans: a keyword automaton first, anchored expressions near its hits, then checksums.

One pass of an Aho-Corasick automaton over a text finds the keywords of all rules at once; only
where a keyword ends is its rule's expression tried, anchored at the place that the keyword
fixes. Formats that carry a checksum are then held against it.
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
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern is tried where a keyword begins and its group 1 is the secret;
    check says whether a secret's checksum holds, or for how many of its first signs. fold: the
    pattern matches in any case. Letters, digits and blanks of patterns are those of ASCII."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool | int] | None = None
    fold: bool = False

    def holds(self, secret: str) -> int:
        """The length of what holds of a secret that the pattern found, 0 where nothing does or
        the check can't read it."""
        try:
            found = self.check is None or self.check(secret)
        except (ValueError, ArithmeticError, LookupError):
            return 0
        return len(secret) if found is True else int(found)


def base62(number: int, width: int) -> str:
    """number in base 62, with leading zeros to width."""
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = _ALPHABET[digit] + out
    return out.rjust(width, "0")


def crc_token(secret: str) -> bool:
    """The last six signs are the CRC-32, in base 62, of those between the prefix and them."""
    body = secret[secret.rindex("_") + 1 :]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def luhn(number: str) -> bool:
    """The check digit of payment card numbers."""
    digits = [int(x) for x in number if x.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    """The remainder by 97 of an international account number is 1."""
    own = text.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in own[4:] + own[:4])) % 97 == 1


def _longest(text: str, good: Callable[[str], bool], least: int) -> int:
    """The length of the longest run of groups, from the first, that is good and has least signs;
    what stands behind a number looks like one more group of it."""
    ends = [m.start() for m in re.finditer("[ -]", text)] + [len(text)]
    return next((e for e in reversed(ends) if len(re.sub("[ -]", "", text[:e])) >= least and good(text[:e])), 0)


def card_number(text: str) -> int:
    """How many of the first signs are a payment card number."""
    return _longest(text, luhn, 13)


def account_number(text: str) -> int:
    """How many of the first signs are an international account number."""
    return _longest(text, iban, 15)


def json_token(token: str) -> bool:
    """The first part of a signed web token is a JSON object with an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def key_block(text: str) -> bool:
    """What stands between the marks of a private key decodes as base 64; line breaks may be escaped."""
    inner = re.sub(r"\\+[rn]", "\n", text[text.index("KEY-----") + 8 : text.rindex("-----END")])
    body = "".join(x for x in inner.splitlines() if ":" not in x)
    try:
        return len(base64.b64decode("".join(body.split()), validate=True)) >= 16
    except (ValueError, binascii.Error):
        return False


def varied(secret: str) -> bool:
    """The signs of a secret without checksum are as varied as chance makes them: hex digits of
    2.5 bits each at least, others 3 bits; short ones half a bit less than all different."""
    n, counts = len(secret), Counter(secret)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return bits >= min(2.5 if re.fullmatch(r"[0-9a-fA-F]+", secret) else 3.0, math.log2(n) - 0.5)


_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "auth_key", "private_key", "client_secret")
RULES: tuple[Rule, ...] = (
    Rule("assigned_secret", _NAMES, r"""(?:token|secret|passw(?:or)?d|api[_-]?key|(?:access|auth|private)_key|client_secret)\\?["']?\s{0,4}(?:=|:=|:|=>)\s{0,4}\\?["']?((?!<\w+>)(?:(?<=")(?=[A-Za-z_\-]*[^A-Za-z_\-\s"])(?:[^\s"\\]|\\[^\s"])*+(?=\\?")(?<=[^\s"]{8})|(?<=')(?=[A-Za-z_\-]*[^A-Za-z_\-\s'])(?:[^\s'\\]|\\[^\s'])*+(?=\\?')(?<=[^\s']{8})|[A-Za-z0-9_\-+/.=]{20,}+(?![A-Za-z0-9_\-+/=])))""", varied, fold=True),
    Rule("repository_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])", crc_token),
    Rule("package_token", ("npm_",), r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9_])", crc_token),
    Rule("cloud_access_key", ("AKIA", "ASIA"), r"((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", None),
    Rule("cloud_api_key", ("AIza",), r"(AIza[0-9A-Za-z_\-]{35})(?![0-9A-Za-z_\-])", None),
    Rule("payment_key", ("sk_live_", "rk_live_"), r"((?:sk|rk)_live_[0-9a-zA-Z]{24,})(?![0-9a-zA-Z])", None),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(xox[bpars]-[0-9A-Za-z-]{20,})(?![0-9A-Za-z-])", None),
    Rule("forge_token", ("glpat-",), r"(glpat-[0-9A-Za-z_\-]{20})(?![0-9A-Za-z_\-])", None),
    Rule("model_hub_token", ("hf_",), r"(hf_[A-Za-z]{34})(?![A-Za-z0-9])", None),
    Rule("mail_key", ("SG.",), r"(SG\.[0-9A-Za-z_\-]{22}\.[0-9A-Za-z_\-]{43})(?![0-9A-Za-z_\-])", None),
    Rule("web_token", ("eyJ",), r"(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_\-])", json_token),
    Rule("private_key", ("-----BEGIN ",), r"(-----BEGIN (?:[A-Z0-9]{1,12} ){0,2}PRIVATE KEY-----(?:[^-]|-(?!----)){16,}-----END (?:[A-Z0-9]{1,12} ){0,2}PRIVATE KEY-----)", key_block),
    Rule("url_password", ("://",), r"://[^\s:/@]+:([^\s:/@]{3,})@[A-Za-z0-9]", None),
    Rule("bearer_token", ("bearer ",), r"bearer\s([A-Za-z0-9_\-+/.]{20,}={0,2})(?![A-Za-z0-9_\-+/=])", varied, fold=True),
    Rule("account_number", ("iban",), r"iban[:\s]{0,3}([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", account_number, fold=True),
    Rule("card_number", ("card", "visa", "mastercard", "pan:"), r"(?:card|visa|mastercard|pan:)[^\d\n]{0,24}(\d(?:[ -]?\d){12,18})(?!\d)", card_number, fold=True),
)

#: Signs that may not stand before a keyword, as part of a longer word.
_BEFORE = re.compile(r"[A-Za-z0-9_\-]")
_GLUED = {"assigned_secret", "url_password", "card_number"}
_machines: dict[tuple[Rule, ...], tuple] = {}


def _machine(rules: tuple[Rule, ...]) -> tuple:
    """The automaton from keywords, in lower case, to (length, rule numbers), and the compiled rules."""
    if rules not in _machines:
        words: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for w in r.keywords:
                words.setdefault(w.lower(), []).append(i)
        machine = ahocorasick.Automaton()
        for w, i in words.items():
            machine.add_word(w, (len(w), tuple(i)))
        machine.make_automaton()
        _machines[rules] = (machine, [re.compile(r.pattern, re.A | (re.I if r.fold else 0)) for r in rules])
    return _machines[rules]


def _fold(text: str) -> str:
    """Lower case with every sign in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def find_secrets(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) of the secrets in text, by place; of overlapping ones the first, and of
    those that start at one place the longest."""
    machine, compiled = _machine(rules)
    found = []
    for end, (length, numbers) in machine.iter(_fold(text)):
        at = end - length + 1
        for i in numbers:
            r = rules[i]
            if at and r.name not in _GLUED and _BEFORE.match(text, at - 1):
                continue
            m = compiled[i].match(text, at)
            if m and (n := r.holds(m[1])):
                found.append((m.start(1), -m.start(1) - n, i))
    out: list[tuple[str, int, int]] = []
    for start, end, i in sorted(set(found)):
        if not out or start >= out[-1][2]:
            out.append((rules[i].name, start, -end))
    return out


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with a mark in the place of each secret."""
    parts, at = [], 0
    for name, start, end in found:
        parts += [text[at:start], f"<{name}>"]
        at = end
    return "".join([*parts, text[at:]])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _find(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"rule": n, "start": s, "end": e} for n, s, e in find_secrets(t.as_py())] if t.is_valid else [] for t in texts], kind)


@F.arrow_udf(T.StringType())
def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        own = (t.as_py() for t in texts)
        yield pa.array([None if t is None else redacted(t, found) if (found := find_secrets(t)) else t for t in own], pa.string())


def scan_secrets(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, rule, start, end) of every secret, start and end counted in characters from 0.

    Null and empty texts hold none; a null doc_id stays null; repeated rows report each their
    own; an empty table gives an empty result. Whole texts are scanned. Other columns are left
    aside.
    """
    small_batches(documents.sparkSession)
    own = documents.select(F.col(id_col).alias("doc_id"), F.explode(_find(F.col(text_col))).alias("f"))
    return own.select("doc_id", "f.rule", "f.start", "f.end")


def redact_secrets(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """documents with a mark in the place of each secret, and the number of characters to match.

    All rows and columns stay, repeated rows too, whatever the columns' names; null texts stay
    null and keep their number, empty texts and those without secrets stay as they are. Whole
    texts are scanned, however long; an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    text = _redact(F.col(text_col))
    out = documents.withColumn(text_col, text)
    if chars_col in documents.columns:
        kind = documents.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.coalesce(F.length(F.col(text_col)).cast(kind), F.col(chars_col)))
    return out
