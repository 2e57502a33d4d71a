"""Personal data by weak supervision.

Every candidate span gets votes (+1, 0, -1) from labelers: patterns with their
check digits, gazetteers, and words around the span.  Candidates of equal kind,
votes and shape are one pattern; Spark counts the patterns over all documents.
Expectation-maximisation on these counts estimates how reliable each labeler is,
and its posteriors train the span classifier (a logistic regression over votes
and shape), which decides on each pattern.  Spans of the base rules are always
reported; the classifier adds spans that the base rules miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Stretches that can hold an ip, card or phone, from their first digit or bracket.
STRETCH = re.compile(r"[0-9(][\x20().0-9-]*")
# Only a run's first digit can begin an ip: later ones would fail as it does.
DOTTED = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
INTERNATIONAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Spelled-out mail addresses: name (at) host (dot) tld.
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z0-9-]{1,63}){1,8}",
    re.IGNORECASE,
)
LOCAL_PHONE = re.compile(r"\(?[0-9]{2,5}\)?(?:[\x20.-]\(?[0-9]{2,4}\)?){2,5}")

#: Words that speak for or against a kind when they stand just before the span.
FOR_WORDS = {
    EMAIL: ("mail", "e-mail", "email", "contact", "write", "kontakt", "correo", "courriel", "from", "reply"),
    IP: ("ip", "host", "server", "address", "addr", "adresse", "login", "gateway"),
    CARD: ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte", "pan"),
    PHONE: ("tel", "phone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone", "whatsapp", "sms"),
}
AGAINST_WORDS = ("version", "isbn", "issn", "order", "invoice", "serial", "id", "no", "token", "sku", "doi", "ref", "eur", "usd")
WORD = re.compile(r"[^\W\d_]+")
CONTEXT_CHARS = 40

#: Top-level domains, calling codes and issuer prefixes of the gazetteers.
TOP_LEVEL = frozenset("com org net edu gov info io de fr es uk eu us ca ch at it nl be co example".split())
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "52", "54", "55", "57", "61", "81", "86", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62")

LABELERS = ("rule", "check", "gazetteer", "context", "against")
SHAPES = 4
CANDIDATES = "array<struct<kind:int,start:int,end:int,pattern:string>>"
SPANS = f"base array<struct<kind:int,start:int,end:int>>, candidates {CANDIDATES}"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email rule, found from each @, so
    that a long run of letters is read once."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def octets_ok(dotted: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in dotted.split("."))


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches with a plus sign before them and up to their last digit; the rules
    run inside.  Each stretch is taken whole, so runs of brackets are read once."""
    found = []
    for m in STRETCH.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(" ().-"))
        if end - start > 1:
            found.append((start - 1 if start and text[start - 1] == "+" else start, end))
    return found


def rule_matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Matches of the base rules that pass their check, and those that fail it."""
    good = [(EMAIL, *s) for s in emails(text)]
    bad = []
    for a, b in islands(text):
        for m in DOTTED.finditer(text, a, b):
            (good if octets_ok(m[0]) else bad).append((IP, *m.span()))
        for m in DIGITS.finditer(text, a, b):
            d = digits_of(m[0])
            (good if 14 <= len(d) <= 19 and luhn(d) else bad).append((CARD, *m.span()))
        for m in INTERNATIONAL.finditer(text, a, b):
            (good if 10 <= len(digits_of(m[0])) <= 15 else bad).append((PHONE, *m.span()))
    return good, bad


def votes(text: str, kind: int, start: int, end: int, rule: int) -> str:
    """The pattern of a span: kind, votes of the labelers, shape."""
    span = text[start:end]
    digits = digits_of(span)
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    near = WORD.findall(before)[-3:]
    check = gazetteer = 0
    if kind == EMAIL:
        last = re.split(r"[.\s()\[\]{}]+", span.rstrip(")]} "))[-1].lower()
        gazetteer = 1 if last in TOP_LEVEL else -1
        check = 1 if "@" in span and ".." not in span else 0
        shape = 0 if "@" in span else 1
    elif kind == IP:
        check = 1 if octets_ok(span) else -1
        first = span.split(".")[0].lstrip("0")
        gazetteer = -1 if first in ("", "127") or span.startswith("255.255") else 0
        shape = 0 if len(digits) >= 7 else 1
    elif kind == CARD:
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        groups = [len(g) for g in re.split(r"[ -]", span)]
        shape = 0 if len(groups) == 1 else 1 if groups[:3] == [4, 4, 4] else 2
    else:
        check = 1 if 10 <= len(digits) <= 15 else -1
        code = digits if span.startswith("+") else ""
        gazetteer = 1 if code.startswith(CALLING_CODES) else 0
        shape = 0 if span.startswith("+") else 1 if "(" in span else 2
    context = 1 if any(w in FOR_WORDS[kind] for w in near) else 0
    against = -1 if near and near[-1] in AGAINST_WORDS or before.rstrip().endswith(("=", "$", "€", "£", "#")) else 0
    marks = "".join("-0+"[v + 1] for v in (rule, check, gazetteer, context, against))
    return f"{kind}{marks}{shape}"


def find_spans(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans (kind, start, end) by start, then kind; and all candidates with
    their patterns.  Candidates outside the base rules are near misses of the
    rules, spelled-out addresses and phones without a plus sign."""
    good, bad = rule_matches(text)
    base = sorted(good, key=lambda s: (s[1], s[0]))
    taken = sorted((a, b) for _, a, b in base)
    more = [s for s in bad if s[0] != CARD or 13 <= len(digits_of(text[s[1] : s[2]])) <= 19]
    if re.search(r"[(\[{]\s?[aA][tT]\s?[)\]}]", text):
        more += [(EMAIL, *m.span()) for m in SPELLED.finditer(text)]
    for a, b in islands(text):
        for m in LOCAL_PHONE.finditer(text, a, b):
            if 9 <= len(digits_of(m[0])) <= 15:
                more.append((PHONE, *m.span()))
    candidates = [(k, a, b, votes(text, k, a, b, 1)) for k, a, b in base]
    used = np.array(taken, dtype=np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(used[:, 1]) if len(used) else used[:, 1]
    free = 0
    for k, a, b in sorted(set(more), key=lambda s: (s[1], -s[2], s[0])):
        # Not over a base span, and leftmost-longest among themselves.
        before = int(np.searchsorted(used[:, 0], b))
        if a >= free and (before == 0 or ends[before - 1] <= a):
            candidates.append((k, a, b, votes(text, k, a, b, 0)))
            free = b
    return base, candidates


def span_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, candidates), one row per input row."""

    @F.pandas_udf(f"struct<{SPANS.replace('base ', 'base:').replace('candidates ', 'candidates:')}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base, cands = [], []
            for text in texts:
                b, c = find_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
                cands.append([dict(zip(("kind", "start", "end", "pattern"), s, strict=True)) for s in c])
            yield pd.DataFrame({"base": base, "candidates": cands})

    rows = df.select(F.col(id_col).alias("doc_id"), find(whole_text(text_col)).alias("s"))
    return rows.select("doc_id", "s.base", "s.candidates")


def vote_matrix(patterns: list[str]) -> np.ndarray:
    """Votes of each pattern as 0, 1, 2 (against, none, for)."""
    return np.array([["-0+".index(c) for c in p[1:-1]] for p in patterns], dtype=np.int64).reshape(-1, len(LABELERS))


def estimate_reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 60):
    """EM over pattern counts of one kind: prior, P(vote | label) per labeler
    (2 x labelers x 3) and the posterior of each pattern.

    The start leans on the votes' balance; each labeler's table has a small
    prior that a vote for is likelier on true spans."""
    v = vote_matrix(patterns)
    balance = (v - 1).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * (balance - 0.5)))
    pseudo = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])
    prior, table = 0.5, None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        table = np.empty((2, len(LABELERS), 3))
        for y in range(2):
            for j in range(len(LABELERS)):
                table[y, j] = np.bincount(v[:, j], weight[y], 3) + pseudo[y]
                table[y, j] /= table[y, j].sum()
        score = np.log(prior) - np.log(1 - prior)
        score = score + sum(np.log(table[1, j, v[:, j]]) - np.log(table[0, j, v[:, j]]) for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return prior, table, post


def pattern_features(patterns: list[str]) -> np.ndarray:
    """One-hot votes and shape, and a constant."""
    v = vote_matrix(patterns)
    shape = np.array([int(p[-1]) for p in patterns])
    return np.hstack([np.eye(3)[v].reshape(len(patterns), -1), np.eye(SHAPES)[shape], np.ones((len(patterns), 1))])


def train_span_classifier(patterns: list[str], counts: np.ndarray, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels; counts enter by their logarithm, so
    that one frequent pattern does not outweigh all others."""
    x = pattern_features(patterns)
    weight = np.log1p(counts) / np.log1p(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += 2.0 * (x.T @ (weight * (labels - p)) - 1e-3 * w)
    return w


def decide(counts: dict[str, int], threshold: float = 0.9) -> dict[str, float]:
    """Classifier probability of each pattern at ``threshold`` or more that has two
    votes for it and none against: the patterns whose spans are added."""
    accepted: dict[str, float] = {}
    for kind in range(len(KINDS)):
        patterns = sorted(p for p in counts if p[0] == str(kind))
        if not patterns:
            continue
        n = np.array([counts[p] for p in patterns], dtype=np.float64)
        _, _, post = estimate_reliabilities(patterns, n)
        prob = 1 / (1 + np.exp(-pattern_features(patterns) @ train_span_classifier(patterns, n, post)))
        for p, x in zip(patterns, prob.tolist(), strict=True):
            if x >= threshold and p[1:-1].count("+") >= 2 and "-" not in p[1:-1]:
                accepted[p] = x
    return accepted


def _joined(spans: F.Column) -> F.Column:
    """kind:start:end, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    text = F.transform(
        ordered,
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and added spans (arrays of kind number,
    start, end in code points).

    Defined cases: a null or empty text has no spans; repeated rows and null ids
    are treated like any other; texts of any length are read whole, in time
    about linear in their length; an empty table gives no rows; other columns are ignored.
    The span table (no text) is written once to the shared folder: the patterns
    are counted over all of it before any is decided on.
    """
    table = materialize(span_table(df, id_col, text_col), "spans")
    counted = table.select(F.explode("candidates.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    # At most kinds x 3^labelers x shapes rows, whatever the number of documents.
    accepted = decide({r["pattern"]: r["n"] for r in counted.collect()})
    rule_missed = F.filter(
        "candidates",
        lambda c: c["pattern"].isin(sorted(accepted)) & (F.substring(c["pattern"], 2, 1) != "+"),
    )
    plain = F.transform(
        rule_missed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    )
    return table.select("doc_id", "base", plain.alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""

    def of_kind(k: int) -> F.Column:
        # A lambda of two arguments would get the span's place as the second one.
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long")

    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
