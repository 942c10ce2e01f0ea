"""PII by anchor expansion: one Aho-Corasick pass finds at-signs, digits, plus signs, schemes and identifier cues; local parsers expand each anchor to the bounds of an address, number or account and validate it.

Every parser looks at a bounded stretch or goes on behind what it has taken, so time is linear in a text of any length.

Defined cases: a null text is the empty text (no spans). An empty table gives no rows. Each kind's spans are leftmost, non-overlapping and independent of the other kinds'; a match that fails its check is dropped and not retried. Offsets are code points, ends exclusive. Input columns other than the id and the text are ignored, so clashing names can't arise. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, table, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the anchors add to the base ones.
EXTRA_KINDS = ("url", "iban", "account", "login", "secret")
#: Words that announce an account number, and words that announce a secret.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "customer", "member", "user id", "userid", "tax id", "licence", "license")
SECRET_CUES = ("token", "api_key", "apikey", "password", "passwd", "secret", "access_key", "pwd", "passphrase", "client_secret", "private_key")
#: Words that announce the name of an account.
LOGIN_CUES = ("login", "username", "user_name")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'|\\^`{}]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_AFTER_CUE = re.compile(r"[A-Za-z]{0,12}[ ]?(?:number|no\.?|nr\.?|id)?[ ]?[:=#]?[ ]?[\"']?")
_ACCOUNT = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,17}(?![A-Za-z0-9])")
_SECRET_SEP = re.compile(r"[\"']?[ ]?[:=][ ]?[\"']?")
_LOGIN = re.compile(r"[A-Za-z0-9_.-]{3,64}")
_SECRET = re.compile(r"[A-Za-z0-9_\-+/=.]{8,}")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("login", LOGIN_CUES), ("iban", ("iban",))):
        for c in cues:
            for form in {c, c.capitalize(), c.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_state: dict[str, ahocorasick.Automaton] = {}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_stop(text: str, at: int, stop: int) -> int:
    """The end of the longest account number of ISO 13616 in text[at:stop], or 0: with its first four characters moved to the end and letters as 10 to 35, the number is 1 modulo 97."""
    head = int("".join(str(int(c, 36)) for c in text[at : at + 4]))
    rest, n, found = 0, 4, 0
    for i in range(at + 4, stop):
        if text[i] == " ":
            continue
        v = int(text[i], 36)
        rest, n = (rest * (100 if v > 9 else 10) + v) % 97, n + 1
        if n > 34:
            break
        if n >= 15 and (rest * 10**6 + head) % 97 == 1:
            found = i + 1
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in order of start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *EXTRA_KINDS)}
    end = dict.fromkeys(found, 0)  # where each kind's search goes on
    run_end = 0  # of the run of digits that was last looked at
    a = _state.get("a")
    if a is None:
        a = _state["a"] = _automaton()

    def iban(gap: int) -> None:
        if gap < end["iban"] or not (m := _IBAN.match(text, gap)):
            return
        if stop := iban_stop(text, gap, m.end()):  # the greedy match may run into the next word
            found["iban"].append((gap, stop))
            end["iban"] = stop

    for last, (what, n) in a.iter(text):
        at = last - n + 1
        if what == "d":
            if at >= 2 and "A" <= text[at - 1] <= "Z" and "A" <= text[at - 2] <= "Z" and not (at > 2 and text[at - 3].isalnum()):
                iban(at - 2)  # without a cue, the check number decides
            if at >= end["card"]:
                m = _CARD.match(text, at)
                if m:
                    end["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            if at >= end["ip"] and at >= run_end:
                m = _IP.match(text, at)
                if m:
                    end["ip"] = m.end()
                    if all(map(_octet, m.group().split("."))):
                        found["ip"].append(m.span())
                run_end = at + 1
                while run_end < len(text) and "0" <= text[run_end] <= "9":
                    run_end += 1
        elif what == "@":
            left, low = at, end["email"]
            while left > low and text[left - 1] in _LEFT:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((left, m.end()))
                end["email"] = m.end()
        elif what == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif what == "url":
            if at >= end["url"] and (m := _URL_REST.match(text, last + 1)):
                stop = m.end() - (len(m.group()) - len(m.group().rstrip(".,;:!?)")))
                if stop > last + 1:
                    found["url"].append((at, stop))
                    end["url"] = stop
        elif what == "iban":
            iban(_AFTER_CUE.match(text, last + 1).end())
        elif what == "account":
            gap = _AFTER_CUE.match(text, last + 1).end()
            if gap >= end["account"] and (m := _ACCOUNT.match(text, gap)):
                found["account"].append(m.span())
                end["account"] = m.end()
        elif what == "login":
            sep = _SECRET_SEP.match(text, last + 1)
            if sep and sep.end() >= end["login"] and (m := _LOGIN.match(text, sep.end())):
                found["login"].append(m.span())
                end["login"] = m.end()
        elif sep := _SECRET_SEP.match(text, last + 1):
            if sep.end() >= end["secret"] and (m := _SECRET.match(text, sep.end())):
                found["secret"].append(m.span())
                end["secret"] = m.end()
    return found


def span_string(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans count as one, named by the first."""
    spans = sorted(((s, -e, k) for k, v in find_spans(text).items() for s, e in v))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of kind, start, end) of every row; an empty array where nothing is found."""
    schema = "id long, spans array<struct<kind:string,start:int,stop:int>>"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": s, "stop": e} for k, v in find_spans(t).items() for s, e in v] for t in texts_of(b.column(1))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["id", "spans"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)


def scrub(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its own columns, the text redacted; a null text stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        col = pa.array([None if t is None else redact(t) for t in b.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([col if i == at else b.column(i) for i in range(b.num_columns)], names)

    return map_batches(docs, run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """The digest that op10 returns: counts and hash of the base kinds, and all spans as a string."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts_of(b.column(1)):
            f = find_spans(t)
            rows.append([len(f[k]) for k in BASE_KINDS] + [hashlib.sha256(span_string(f, BASE_KINDS).encode()).hexdigest(), span_string(f, (*BASE_KINDS, *EXTRA_KINDS))])
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op10_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
