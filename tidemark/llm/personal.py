"""Personal data by weak supervision.

Four kinds have exact patterns (the base: email, ip, card, phone) whose matches are always spans. Besides, looser
patterns propose candidates (phone numbers without +, names, secrets), on which several labelers vote yes, no or not
at all: the shape, a gazetteer, the context before, a counter-example. What matters of a candidate is its votes and a
coarse form, so all candidates of the corpus are counted by these, of which there are a bounded number; expectation-
maximisation on the counts estimates how reliable each labeler is for each kind and how likely each pattern of votes is
right; on these soft labels a logistic span classifier is trained, and it decides.

Defined cases: a null text is empty; candidates that overlap a base span are dropped; repeated rows are scanned each;
without any candidate no model is needed and only base spans are found; very long runs of digits or letters
are scanned in linear time; empty tables give no rows; other columns play no part, and `redact` keeps them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import logistic, map_rows, settle, text_of

KINDS = ["email", "ip", "card", "phone", "name", "secret"]
EMAIL, IP, CARD, PHONE, NAME, SECRET = range(6)
LOCAL = "".join(map(chr, range(48, 58))) + "".join(map(chr, range(65, 91))) + "".join(map(chr, range(97, 123))) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
NUMBER = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GROUPED = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
TOKEN = re.compile(r"[A-Za-z0-9_]+")
WORD = re.compile(r"\w+")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme)\b\.? +([A-ZÄÖÜÉÈÁÍÓÚÑ]\w+(?: [A-ZÄÖÜÉÈÁÍÓÚÑ]\w+)?)")
KEY_FORMS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}")
FIRST_NAMES = ("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Susan Richard Thomas Sarah Charles "
               "Karen Daniel Nancy Anthony Sandra Andrew Emily Joshua Laura Hans Peter Klaus Monika Jürgen Ursula Stefan Petra "
               "Jean Pierre Marie Michel Nathalie Philippe Isabelle José Carmen Antonio Manuel Francisco Dolores Javier Pilar").split()
GAZETTEER = frozenset(FIRST_NAMES)
#: Lengths that common keys and digests have.
KEY_LENGTHS = frozenset({16, 18, 20, 24, 32, 40, 64})
BEFORE = {
    PHONE: re.compile(r"(?:call|tel|phone|fax|mobile|telefon|tél|móvil)\w*\W*$", re.I),
    NAME: re.compile(r"(?:name|contact|dear|liebe[r]?|cher|chère|querid[oa]|nombre|nom)\W*$", re.I),
    SECRET: re.compile(r"(?:password|passwort|passwd|token|secret|api.?key|key|contraseña|mot de passe)\W{0,6}$", re.I),
}
NEAR = 24
#: Votes of the labelers, in order: shape, gazetteer, context, counter-example.
LABELERS = 4
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match has one @; going from @ to @ finds the leftmost ones without rescanning long runs."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        local = len(head) - len(head.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if local else None
        floor = at + 1
        if domain:
            out.append((at - local, domain.end()))
            floor = domain.end()
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(EMAIL, *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((IP, *m.span()))
        for m in DIGITS.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
        if "+" in text:
            out += [(PHONE, *m.span()) for m in NUMBER.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def tokens_with_digits(text: str):
    end = 0
    for m in DIGIT.finditer(text):
        if m.start() >= end:
            left = m.start()
            while left > end and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] == "_")):
                left -= 1
            end = TOKEN.match(text, m.start()).end()
            yield left, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, pattern) of what looser patterns propose; the pattern has kind, votes and form."""
    found = []

    def propose(kind: int, start: int, end: int, shape: str, gazetteer: str, counter: str) -> None:
        context = vote(bool(BEFORE[kind].search(text[max(0, start - NEAR):start])))
        size = end - start
        form = f"{min(size // 8, 5)}{int(any(map(str.isupper, text[start:end])))}{int(any(map(str.islower, text[start:end])))}"
        found.append((kind, start, end, f"{kind}|{shape}{gazetteer}{context}{counter}|{form}"))

    if DIGIT.search(text):
        for start, end in tokens_with_digits(text):
            if end - start >= 12:
                token = text[start:end]
                digits = sum(map(str.isdigit, token))
                if 0 < digits < len(token):
                    hexa = all(c in "0123456789abcdef" for c in token.lower())
                    mixed = digits >= 3 or hexa
                    propose(SECRET, start, end, vote(bool(KEY_FORMS.fullmatch(token)), digits < 2), vote(len(token) in KEY_LENGTHS, len(token) > 128),
                            vote(mixed and (hexa or token.isupper()), token.rstrip("0123456789").isalpha()))
        for m in GROUPED.finditer(text):
            digits = sum(map(str.isdigit, m[0]))
            propose(PHONE, *m.span(), vote(9 <= digits <= 12, digits < 9), vote(m[0].lstrip("(")[0] in "023456789"), vote("(" in m[0], "." in m[0]))
    for m in TITLED.finditer(text):
        first = m[1].split()[0]
        propose(NAME, *m.span(1), vote(" " in m[1]), vote(first in GAZETTEER), "+")
    for name in GAZETTEER.intersection(WORD.findall(text)):
        for m in re.finditer(rf"\b{name} [A-ZÄÖÜÉÈÁÍÓÚÑ]\w+", text):
            propose(NAME, *m.span(), "+", "+", "0")
    starts = sorted((s, e) for _, s, e in base)
    limits = [s for s, _ in starts]
    reach = np.maximum.accumulate([e for _, e in starts]).tolist() if starts else []

    def clear(start: int, end: int) -> bool:
        k = bisect.bisect_left(limits, end)
        return k == 0 or reach[k - 1] <= start

    return sorted(set(c for c in found if clear(c[1], c[2])))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, base and found: arrays of spans (kind, start, end) and of candidates (also pattern), and base_sha256."""
    def make():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                base = base_spans(t)
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
                yield i, [dict(zip(("kind", "start", "end"), s)) for s in base], [dict(zip(("kind", "start", "end", "pattern"), c)) for c in candidates(t, base)], hashlib.sha256(line.encode()).hexdigest()
        return rows

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make,
                    "doc_id long, base array<struct<kind:int,start:long,end:long>>, "
                    "found array<struct<kind:int,start:long,end:long,pattern:string>>, base_sha256 string")


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], dict[tuple, dict[str, float]]]:
    """Expectation-maximisation over patterns: the chance that a candidate of each pattern is right, and for each
    (kind, labeler, right or not) the chance of each vote."""
    right, rates = {}, {}
    by_kind = defaultdict(list)
    for pattern, n in counts.items():
        by_kind[int(pattern.split("|")[0])].append((pattern, pattern.split("|")[1], n))
    for kind, rows in by_kind.items():
        prior = 0.5
        table = {(k, c): {"+": 0.6, "0": 0.35, "-": 0.05} if c else {"+": 0.1, "0": 0.5, "-": 0.4} for k in range(LABELERS) for c in (0, 1)}
        for _ in range(rounds):
            chance = {}
            for pattern, votes, _n in rows:
                yes, no = prior, 1 - prior
                for k, v in enumerate(votes):
                    yes, no = yes * table[k, 1][v], no * table[k, 0][v]
                chance[pattern] = yes / (yes + no)
            total = sum(n for _, _, n in rows)
            prior = min(0.95, max(0.05, sum(chance[p] * n for p, _, n in rows) / total))
            for (k, c) in table:
                # a prior of pseudo-counts in the direction that a labeler means keeps the classes from changing places
                sums = {"+": 6.0, "0": 3.5, "-": 0.5} if c else {"+": 1.0, "0": 5.0, "-": 4.0}
                for pattern, votes, n in rows:
                    sums[votes[k]] += n * (chance[pattern] if c else 1 - chance[pattern])
                table[k, c] = {v: s / sum(sums.values()) for v, s in sums.items()}
        right |= chance
        rates |= {(kind, *key): value for key, value in table.items()}
    return right, rates


def encode(pattern: str) -> list[float]:
    kind, votes, form = pattern.split("|")
    return [1.0, *(float(kind == str(k)) for k in (PHONE, NAME, SECRET)), *(float(v == "+") for v in votes), *(float(v == "-") for v in votes),
            int(form[0]) / 5, float(form[1]), float(form[2])]


def accepted(scanned: DataFrame) -> list[str]:
    """Patterns that the span classifier takes for personal data. Counted over all rows of `scan`."""
    counted = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().collect()
    counts = {r["pattern"]: r["count"] for r in sorted(counted, key=lambda r: r["pattern"])}
    if not counts:
        return []
    right, _ = estimate(counts)
    x = np.array([encode(p) for p in counts])
    soft, n = np.array([right[p] for p in counts]), np.array(list(counts.values()), float)
    beta = logistic(np.r_[x, x], np.r_[np.ones(len(x)), np.zeros(len(x))], np.r_[n * soft, n * (1 - soft)], ridge=0.1)
    return [p for p, z in zip(counts, x @ beta) if 1 / (1 + np.exp(-z)) >= ACCEPT]


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_more (those added)."""
    scanned = settle(scan(documents))
    takes = accepted(scanned)
    more = F.filter("found", lambda c: c["pattern"].isin(takes)) if takes else F.filter("found", lambda c: F.lit(False))
    more = F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    name = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", more)), lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(EMAIL).alias("n_email"), count(IP).alias("n_ip"), count(CARD).alias("n_card"), count(PHONE).alias("n_phone"),
                          "base_sha256", spans.alias("spans"), F.size(more).cast("long").alias("n_more"))


def mask(text: str, takes: frozenset) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by the kind of its first."""
    base = base_spans(text)
    spans = sorted([(s, e, k) for k, s, e in base] + [(s, e, k) for k, s, e, p in candidates(text, base) if p in takes])
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(documents: DataFrame) -> DataFrame:
    """All columns and rows; in `text` personal data is masked, a null text stays null, and an n_chars column is the new length."""
    takes = frozenset(accepted(scan(documents)))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, takes), na_action="ignore")

    out = documents.withColumn("text", masked(F.col("text")))
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out
