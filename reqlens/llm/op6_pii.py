"""Personal data by weak supervision (operator 6).

Base spans (email, ip, card, phone) are found by fixed patterns and always
stay.  Further *candidates* - looser shapes of the same kinds and secrets,
numbers and handles - are put to labelers: regular expressions, a gazetteer of
cue words and the words around the span each vote yes, no or abstain.  An
expectation-maximisation pass (Dawid and Skene's model, two classes) over the
vote patterns of the whole corpus estimates each labeler's reliability and each
pattern's probability; these are the soft labels of a logistic span classifier
on shape features, and its verdict adds spans.

Only two bounded tables reach the driver: counts per vote pattern (at most
3 ** labelers) and per feature pattern.  Candidates are found and decided map
side, document by document; no document is shuffled.

Defined cases: null and empty texts have no spans (the digest of an empty
list); repeated rows each get theirs; without candidates nothing is trained and
only base spans remain; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import land, read_table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ------------------------------------------------------------ base patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: a match can only begin where a run of digits begins, so runs are entered once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: a match holds exactly one @, and its
    local part reaches back from there as far as the last match allows."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[Span]:
    """Base spans, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):     # the other kinds all hold digits
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# --------------------------------------------------------------- candidates
#: fixed values: cue words of each kind
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel", "telefono"),
    "secret": ("token", "key", "secret", "password", "passwd", "api_key", "apikey", "pwd", "auth"),
}
#: kinds the method adds spans of, each with its loose shape
LOOSE = {
    "phone": re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![\w-])"),
    "email": re.compile(r"(?<![\w.])[\w.]{1,64}(?: ?\[at\] ?| ?\(at\) ?)[\w-]{1,64}(?: ?\[dot\] ?| ?\(dot\) ?|\.)[a-z]{2,12}(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}(?![A-Za-z0-9_])"),
}
_BEFORE = re.compile(r"[\w-]{2,16}")
LABELERS = ("shape", "checksum", "cue", "assignment", "alone", "mixture")


def _votes(kind: str, s: str, before: str, after: str) -> tuple[int, ...]:
    """One vote per labeler: 1 yes, 0 no, -1 abstains."""
    digits = _digits(s)
    near = [w.lower() for w in _BEFORE.findall(before)[-4:]]
    cue = [k for k, words in CUES.items() if any(w in words for w in near)]
    share = len(digits) / len(s)
    hexa = all(ch in "0123456789abcdefABCDEF" for ch in s)
    return (
        # regular expressions: a stricter shape of the kind
        {"phone": 1 if 9 <= len(digits) <= 13 else 0, "card": 1 if len(digits) == 16 else 0,
         "email": 1, "secret": 1 if hexa and len(s) in (32, 40, 64) else (-1 if hexa else 0)}[kind],
        {"card": int(luhn(digits)), "phone": -1}.get(kind, -1),
        # gazetteer
        1 if kind in cue else (0 if cue else -1),
        # context
        1 if re.search(r"[=:]\s*[\"']?$", before) else -1,
        1 if not before.strip() or before[-1:].isspace() and (not after or after[:1].isspace() or after[:1] in ",.;!") else 0,
        {"secret": 1 if 0.2 <= share <= 0.8 else 0, "card": 1 if len(set(digits)) > 2 else 0,
         "phone": 1 if len(set(digits)) > 2 else 0}.get(kind, -1),
    )


def _features(kind: str, s: str, before: str, after: str) -> tuple[int, ...]:
    """Bounded shape features of a span."""
    share = len(_digits(s)) / len(s)
    return (tuple(LOOSE).index(kind), min(len(s) // 8, 8), int(share * 4), int(any(c.isupper() for c in s)),
            int(any(c.islower() for c in s)), int(bool(re.search(r"[=:]\s*[\"']?$", before))),
            int(before[-1:] in ('"', "'")), int(after[:1] in ('"', "'")))


def candidates(text: str, base: list[Span]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, votes, features) of loose spans that overlap no base
    span, leftmost per kind.  All but obfuscated addresses hold a digit."""
    if not _DIGIT.search(text) and "[at]" not in text and "(at)" not in text:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    out = []
    for kind, shape in LOOSE.items():
        for m in shape.finditer(text):
            a, b = m.span()
            before_b = bisect_left(starts, b)
            if before_b and reach[before_b - 1] > a or kind != "email" and not _digits(m.group()):
                continue
            before, after = text[max(0, a - 40):a], text[b:b + 8]
            out.append((kind, a, b, ",".join(map(str, _votes(kind, m.group(), before, after))),
                        ",".join(map(str, _features(kind, m.group(), before, after)))))
    return out


# ------------------------------------------------------------------ training
def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns.  Returns each pattern's
    probability of being personal data, and the rate of yes votes of every
    labeler (where it votes) on true and on false spans."""
    said = votes >= 0
    yes = (votes == 1).sum(1) / np.maximum(said.sum(1), 1)
    p = np.clip(yes, 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = p * count, (1 - p) * count
        rate = [((votes == 1) * w[:, None]).sum(0) + r1 for w, r1 in ((w1, 1.6), (w0, 0.4))]
        seen = [(said * w[:, None]).sum(0) + 2.0 for w in (w1, w0)]
        true, false = rate[0] / seen[0], rate[1] / seen[1]
        prior = (w1.sum() + 1) / (count.sum() + 2)
        ll = [np.log(q) + np.where(votes == 1, np.log(r), np.where(votes == 0, np.log1p(-r), 0)).sum(1)
              for q, r in ((prior, true), (1 - prior, false))]
        new = 1 / (1 + np.exp(np.clip(ll[1] - ll[0], -40, 40)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, true, false


def _design(features: list[str]) -> np.ndarray:
    """One-hot columns of bounded features."""
    x = np.array([[int(v) for v in f.split(",")] for f in features])
    top = (len(LOOSE), 9, 5, 2, 2, 2, 2, 2)
    return np.concatenate([np.ones((len(x), 1))] + [np.eye(t)[x[:, i]] for i, t in enumerate(top)], axis=1)


def train(features: list[str], soft: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, weighted by counts."""
    x, w = _design(features), None
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (count * (soft - p)) - ridge * w
        h = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def span_probabilities(found: DataFrame) -> dict[str, float]:
    """Probability per feature pattern, from the candidates of all documents."""
    both = found.select(F.explode("cand").alias("c")).select("c.votes", "c.features")
    table = both.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()   # bounded patterns
    if not table:
        return {}
    patterns = sorted({r["votes"] for r in table})
    count = np.zeros(len(patterns))
    for r in table:
        count[patterns.index(r["votes"])] += r["n"]
    soft, _, _ = estimate(np.array([[int(v) for v in p.split(",")] for p in patterns]), count)
    of = dict(zip(patterns, soft))
    shapes = sorted({r["features"] for r in table})
    n, y = np.zeros(len(shapes)), np.zeros(len(shapes))
    for r in table:
        i = shapes.index(r["features"])
        n[i] += r["n"]
        y[i] += r["n"] * of[r["votes"]]
    w = train(shapes, y / n, n)
    return dict(zip(shapes, (1 / (1 + np.exp(-np.clip(_design(shapes) @ w, -30, 30)))).tolist()))


# -------------------------------------------------------------------- Spark
_CAND = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()),
                            ("votes", pa.string()), ("features", pa.string())]))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans ("kind:start:end", joined) with their counts, and the
    candidates."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cand = [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append(spans)
                cand.append([dict(zip(("kind", "s", "e", "votes", "features"), c)) for c in candidates(text or "", spans)])
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([joined(s) for s in base], pa.string()), *counts, pa.array(cand, _CAND)],
                ["doc_id", "base", *[f"n_{k}" for k in KINDS], "cand"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find, "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, "
              "cand array<struct<kind:string,s:long,e:long,votes:string,features:string>>")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_ORDER = {k: i for i, k in enumerate((*KINDS, *[k for k in LOOSE if k not in KINDS]))}


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans of every document: counts and digest of the base ones, and all
    spans with those the classifier adds."""
    found = land(found_spans(docs), "pii-spans")
    prob = span_probabilities(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, every, added = [], [], []
            for base, cand in zip(b.column(1).to_pylist(), b.column(6).to_pylist()):
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                more = [(c["kind"], c["s"], c["e"]) for c in cand if prob[c["features"]] >= threshold]
                every.append(joined(sorted(spans + more, key=lambda x: (_ORDER[x[0]], x[1], x[2]))))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(i) for i in range(2, 6)], pa.array(digest, pa.string()), pa.array(every, pa.string()),
                 pa.array(added, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                    "base_sha256 string, spans string, n_added long")


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
