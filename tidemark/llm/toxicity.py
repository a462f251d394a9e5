"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become a few classes: insults (words and word beginnings whose weight is learned from labelled documents), threats,
targets ("you", "sie", ...), negations and words of reported speech (fixed lists in four languages), ends of
clauses, and everything else. Five small transducers read the classes: one weighs insults, one threats, one
remembers a target, one a negation, one reported speech. `compose` multiplies them into one machine, whose state at
the end of a clause says what the clause holds: an insult or a threat, aimed, negated or reported. A clause counts by
its state and the largest weight of an insult in it; how much each kind of clause, and how many there are in a text of
some length, says is fitted on labelled documents.

Defined cases: a null text is empty; a text without matched clauses gets the fitted base score; repeated rows are
scored each; null labels are not used, of several labels of one document the largest counts; with no labelled
example of either class all scores are 0; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Memo, arrow_schema, fold, logistic, map_rows, text_of
from .quality import bounded, labelled, one_each

#: At most about so many labelled documents are learned from, and at most so many cues are kept.
MAX_LABELLED = 20_000
#: Letters of a word beginning that may be a cue; a cue must occur in so many toxic documents, with this G statistic.
PREFIXES, MIN_DOCUMENTS, MIN_G = range(3, 8), 4, 28.0

THREATS = ("kill hurt destroy murder shoot stab burn beat strangle töten umbringen schlagen vernichten erschießen tuer "
           "frapper détruire brûler matar golpear destruir quemar").split()
TARGETS = "you your yours youre he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never isnt arent wasnt dont doesnt didnt nobody nicht kein keine keiner nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say wrote writes called quoted claims reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
CLASSES = {w: k for k, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}


class Transducer:
    """step[state][class] is the next state; say[state] what the state means when the clause ends. State 0 is the start."""

    def __init__(self, step: list[list[int]], say: list[tuple]):
        self.step, self.say = step, say


def remembers(*classes: int) -> Transducer:
    """Says 1 once one of the classes was read in the clause, else 0."""
    return Transducer([[int(c in classes) for c in range(7)], [1] * 7], [(0,), (1,)])


def remembers_before(mark: int, *classes: int) -> Transducer:
    """Says 1 if `mark` was read before the first of the classes, else 0."""
    start = [1 if c == mark else 2 if c in classes else 0 for c in range(7)]
    open_ = [3 if c in classes else 1 for c in range(7)]
    return Transducer([start, open_, [2] * 7, [3] * 7], [(0,), (0,), (0,), (1,)])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: states are pairs, and what they say is joined."""
    pairs = list(product(range(len(a.step)), range(len(b.step))))
    number = {p: k for k, p in enumerate(pairs)}
    return Transducer([[number[a.step[p][c], b.step[q][c]] for c in range(7)] for p, q in pairs], [a.say[p] + b.say[q] for p, q in pairs])


def grammar() -> Transducer:
    machine = remembers(INSULT)
    for part in (remembers(THREAT), remembers(TARGET), remembers_before(NEGATION, INSULT, THREAT), remembers_before(REPORT, INSULT, THREAT)):
        machine = compose(machine, part)
    return machine


MACHINE = grammar()
FEATURES = ["plain", "aimed", "negated", "reported", "threat", "aimed_threat", "clauses", "weight", "second", "length"]
INNER = re.compile(r"\w+")


def chunks(text: str) -> list[str]:
    return text.lower().replace("\n", " . ").split()


def beginnings(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if k < len(word))]


def read(chunk: str, cues: dict[str, float]) -> tuple[int, float]:
    """The class and weight of a chunk between spaces, in one number: class, plus 8 if a clause ends after it."""
    kind, weight = OTHER, 0.0
    for word in INNER.findall(chunk):
        w = max((cues[b] for b in beginnings(word) if b in cues), default=0.0)
        if w > weight:
            kind, weight = INSULT, w
        elif kind == OTHER:
            kind = CLASSES.get(word, OTHER)
    return kind + 8 * chunk.endswith((".", "!", "?", ";", ":")), weight


def clause_features(text: str, memo: Memo) -> list[float]:
    got = list(map(memo.__getitem__, chunks(text)))
    out = [0.0] * len(FEATURES)
    if not any(k & 7 in (INSULT, THREAT) for k, _ in set(got)):
        return out
    state, most, weights = 0, 0.0, []
    for k, w in [*got, (8, 0.0)]:
        if k & 7:
            state = MACHINE.step[state][k & 7]
            most = max(most, w)
        if k & 8:
            insult, threat, target, negated, reported = MACHINE.say[state]
            if insult or threat:
                name = 2 if negated else 3 if reported else (1 if target else 0) if insult else 5 if target else 4
                out[name] = max(out[name], most if insult else 1.0)
                if insult:
                    weights.append(most)
            state, most = 0, 0.0
    weights.sort()
    out[6:] = [float(np.log1p(len(weights))), float(np.log1p(sum(weights))), weights[-2] if len(weights) > 1 else 0.0, float(np.log1p(len(got))) / 10]
    return out


def learn_cues(examples: DataFrame) -> dict[str, float]:
    """Weights of words and beginnings: smoothed log odds where the G statistic is large. `examples` has text and y.
    Counted on the executors; equal texts count once."""
    once = examples.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y"))

    schema = "cue string, pos long, neg long, docs_pos long, docs_neg long"
    target = arrow_schema(schema)

    def run(batches):
        counts, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(*[c.to_pylist() for c in batch.columns]):
                n[y] += 1
                words = {w for c in set(chunks(text)) for w in INNER.findall(c)}
                counts[y].update({b for w in words for b in beginnings(w)})
        cues = [*{*counts[0], *counts[1]}]
        rows = [[None, *cues], [0, *(counts[1][c] for c in cues)], [0, *(counts[0][c] for c in cues)],
                [n[1], *[0] * len(cues)], [n[0], *[0] * len(cues)]]
        for k in range(0, len(cues) + 1, 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 20_000], type=f.type) for c, f in zip(rows, target)], schema=target)

    parts = once.select("text", "y").mapInArrow(run, schema)
    counted = parts.groupBy("cue").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "docs_pos", "docs_neg")])
    rows = counted.where(f"cue is null or (pos >= {MIN_DOCUMENTS} and pos > neg)").collect()
    total = next((r for r in rows if r["cue"] is None), None)
    if total is None or not total["docs_pos"] or not total["docs_neg"]:
        return {}
    n1, n0 = total["docs_pos"], total["docs_neg"]
    found = []
    for r in rows:
        if r["cue"] is None:
            continue
        a, b = r["pos"], r["neg"]
        share = (a + b) / (n1 + n0)
        g = 2 * sum(x * np.log(x / e) for x, e in ((a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share))) if x > 0 and e > 0)
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if g >= MIN_G and odds > np.log(8):
            found.append((g, r["cue"], float(odds)))
    return {cue: odds for _, cue, odds in sorted(found, key=lambda x: (-x[0], x[1]))}


def score(documents: DataFrame, labels: DataFrame, column: str = "toxic", parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (matched clauses with an insult)."""
    chosen = F.broadcast(bounded(labelled(labels, column, parts, held_out), MAX_LABELLED))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    examples = texts.join(chosen, "doc_id")
    cues = learn_cues(examples)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(cues)

    def make():
        memo = Memo(lambda chunk: read(chunk, shared.value))

        def rows(ids, bodies, *rest):
            for i, t, *r in zip(ids, bodies, *rest):
                memo.trim()
                yield i, *r, *clause_features(t, memo)
        return rows

    columns = ", ".join(f"{f} double" for f in FEATURES)
    read_ = map_rows(examples.select("doc_id", "text", "y"), make, f"doc_id long, y int, {columns}")
    got = one_each(read_, FEATURES).toPandas().sort_values(["doc_id", *FEATURES])
    x, y = got[FEATURES].to_numpy(float), got["y"].to_numpy(float)
    if len(set(y)) == 2:
        beta = np.append(*_fit(x, y))
    else:
        beta = np.append(np.zeros(len(FEATURES)), -40.0)
    worth = sum((F.col(f) * float(b) for f, b in zip(FEATURES, beta)), F.lit(float(beta[-1])))
    scored = map_rows(texts, make, f"doc_id long, {columns}")
    clipped = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), worth))
    return scored.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), (1 / (1 + F.exp(-clipped))).alias("score"),
                         F.round(F.expm1("clauses")).cast("long").alias("clauses")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    beta = logistic(np.c_[x, np.ones(len(y))], y, ridge=0.1)
    return beta[:-1], beta[-1]
