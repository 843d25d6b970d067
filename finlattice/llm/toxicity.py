"""Toxicity: a weighted finite-state grammar over clauses, cascades of transducers each reading what the last one wrote; lexicon and calibration are learned from labels."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import documents, texts
from finlattice.session import ship_package

#: Labelled rows that a model is learned from at most: those whose ids have the least hashes. The one bound here; scores read all rows.
LABELLED = 20_000
#: An entry of the lexicon stands in this many positive documents at least, and its log odds stay above the limit when a standard error is taken off.
DOCUMENTS, LOG_ODDS = 5, 2.5
HELD_OUT = 5

# Word lists of the grammar, fixed values.
THREATS = {
    *("kill killing murder slaughter strangle choke hang behead lynch stab shoot burn beat hurt destroy crush smash punch drown poison cripple hunt bury").split(),
    *("töten tötet umbringen erschießen erschlagen erwürgen verprügeln zusammenschlagen zerstören verbrennen vernichten abstechen aufhängen").split(),
    *("tuer tuerai tue frapper détruire brûler étrangler égorger poignarder écraser pendre massacrer").split(),
    *("matar mataré matamos golpear destruir quemar apuñalar ahorcar degollar aplastar estrangular").split(),
}
#: People who are spoken to or about, where they stand as an object after a verb or anywhere beside an insult.
TARGETS = {
    *("you your you're youre yours yourself u ur he she they him her them himself herself themselves everyone").split(),
    *("du ihr er sie ihm ihnen dein deine toi vous il elle ils elles ton ta tu tú vosotros usted ustedes él ella ellos ellas").split(),
}
#: Objects that stand before their verb.
OBJECTS = {*"dich euch ihn te".split()}
NEGATIONS = {
    *("not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot couldn't shouldn't without hardly").split(),
    *("nicht kein keine keinen nie niemals ohne pas jamais sans aucun nunca jamás sin ningún").split(),
}
REPORTS = {
    *("said says say saying wrote writes quoted quotes called claims claimed reported reports alleged alleges shouted yelled quote word term headline").split(),
    *("sagte sagt schrieb schreibt behauptet rief zitierte laut dit écrit affirme déclare selon cria dijo dice escribió afirma según gritó").split(),
}
OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, NOTHING = range(8)
CLASSES = ((THREATS, THREAT), (OBJECTS, OBJECT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
#: Marks that the machines write onto the head of a clause, an insult or a threat: a symbol is a class and its marks.
AIMED, NEGATED, REPORTED = 8, 16, 32
#: How far in words a negation, a person and an object reach.
NEAR, BESIDE, AFTER_VERB, BEFORE_VERB = 4, 6, 3, 3
THREAT_WEIGHT = 6.0
#: What a clause pays for its heads by pattern. An insult counts in full with a person beside it; a threat without one is no clause of this grammar.
FULL, BARE, UNDER_NEGATION, UNDER_REPORT = 1.0, 0.5, 0.1, 0.15
MARKS = ".,!?;:\"'()[]{}<>*#$%&|-_~`"
CLAUSE_ENDS = tuple(".!?;:|")
ENDS = 8


@dataclass(frozen=True)
class Transducer:
    """A sequential machine: arcs[state, symbol] is (next state, symbol written). What has no arc is copied and keeps the state."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, tape: Iterable[int]) -> list[int]:
        state, out, arcs = 0, [], self.arcs
        for symbol in tape:
            state, symbol = arcs.get((state, symbol), (state, symbol))
            out.append(symbol)
        return out

    def then(self, other: Transducer) -> Transducer:
        """The machine that reads once and writes what other writes on reading what this one writes."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            p, q = todo.pop()
            for symbol in SYMBOLS:
                p2, between = self.step(p, symbol)
                q2, written = other.step(q, between)
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    todo.append((p2, q2))
                arcs[number[p, q], symbol] = number[p2, q2], written
        return Transducer(arcs)


def _symbols() -> list[int]:
    marks = [a | n | r for a in (0, AIMED) for n in (0, NEGATED) for r in (0, REPORTED)]
    return [k | m for k in range(NOTHING) for m in (marks if k in (INSULT, THREAT) else (0,))]


SYMBOLS = _symbols()


def marker(triggers: tuple[int, ...], heads: tuple[int, ...], mark: int, reach: int | None) -> Transducer:
    """Marks heads that stand at most `reach` words after a trigger, or anywhere after one in the clause. State k: k more words are in reach."""
    arcs = {}
    for state in range((reach or 1) + 1):
        for symbol in SYMBOLS:
            kind = symbol & 7
            left = max(0, state - 1) if reach else state
            if kind in triggers:
                arcs[state, symbol] = reach or 1, symbol
            else:
                arcs[state, symbol] = left, symbol | mark if state and kind in heads else symbol
    return Transducer(arcs)


def cascade(*machines: Transducer) -> Transducer:
    first, *rest = machines
    for m in rest:
        first = first.then(m)
    return first


_HEADS, _PEOPLE = (INSULT, THREAT), (TARGET, OBJECT)
#: A machine sees only what it has read, so there are two: one reads a clause forwards, the other reads backwards what the first has written.
FORWARD = cascade(marker((NEGATION,), _HEADS, NEGATED, NEAR), marker((REPORT,), _HEADS, REPORTED, None), marker(_PEOPLE, (INSULT,), AIMED, BESIDE), marker((OBJECT,), (THREAT,), AIMED, BEFORE_VERB))
BACKWARD = cascade(marker((NEGATION,), _HEADS, NEGATED, NEAR), marker((REPORT,), _HEADS, REPORTED, None), marker(_PEOPLE, (INSULT,), AIMED, BESIDE), marker(_PEOPLE, (THREAT,), AIMED, AFTER_VERB))


def payment(symbol: int) -> float:
    """What a marked head pays, as a share of its word's weight."""
    kind = symbol & 7
    if kind not in _HEADS:
        return 0.0
    full = FULL if symbol & AIMED else BARE if kind == INSULT else 0.0
    return full * (UNDER_NEGATION if symbol & NEGATED else 1.0) * (UNDER_REPORT if symbol & REPORTED else 1.0)


PAYS = [payment(s) for s in range(64)]


def read_clause(tape: list[int]) -> list[int]:
    """The tape of a clause with its heads marked."""
    return BACKWARD.run(reversed(FORWARD.run(tape)))[::-1]


def bare(word: str) -> str:
    return word.strip(MARKS).lower()


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.weights[0] + evidence @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Reader(dict):
    """Class of each raw word, worked out once, and ENDS beside it if it ends a clause."""

    SIZE = 400_000
    HEAD = np.isin(np.arange(16) & 7, _HEADS)

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        word = bare(raw)
        if not word:
            kind = NOTHING
        elif word in self.lexicon:
            kind = INSULT
        else:
            kind = next((k for words, k in CLASSES if word in words), OTHER)
        got = kind | ENDS if raw.endswith(CLAUSE_ENDS) else kind
        if len(self) >= self.SIZE:
            self.clear()
        if len(raw) <= 64:
            self[raw] = got
        return got

    def evidence(self, text: str) -> tuple[float, float, float]:
        """log(1 + x) of the sum of clause scores, of the greatest, and of the number of clauses with any. A clause ends at a mark or a line's end."""
        raw = text.replace("\n", " . ").split()
        codes = np.fromiter(map(self.__getitem__, raw), np.uint8, len(raw))
        heads = np.nonzero(self.HEAD[codes])[0]
        if not len(heads):
            return 0.0, 0.0, 0.0
        ends = np.append(np.nonzero(codes & ENDS)[0], len(raw) - 1)
        total = top = 0.0
        clauses = 0
        for k in np.unique(np.searchsorted(ends, heads)).tolist():
            start, stop = int(ends[k - 1]) + 1 if k else 0, int(ends[k]) + 1
            kinds = codes[start:stop] & 7
            some = kinds != NOTHING
            marked = read_clause(kinds[some].tolist())
            places = (np.nonzero(some)[0] + start).tolist()
            here = sum(pays * self.weight(raw[i]) for i, symbol in zip(places, marked, strict=True) if (pays := PAYS[symbol]))
            if here:
                total, top, clauses = total + here, max(top, here), clauses + 1
        return math.log1p(total), math.log1p(top), math.log1p(clauses)

    def weight(self, raw: str) -> float:
        return self.lexicon.get(bare(raw), THREAT_WEIGHT)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 on division by 5; a null id counts as empty text, and so is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % HELD_OUT == 0


def _sketch(text: str) -> int:
    words = text.encode().split()
    return min((xxhash.xxh64_intdigest(b" ".join(w)) for w in zip(words, words[1:], words[2:], strict=False)), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of label_col, from at most `labelled` labelled rows that aren't held out; near copies among them count once in the lexicon.

    Word counts are made by Spark; the driver gets the lexicon (words in DOCUMENTS or more of the positive rows, so `labelled` bounds it too) and
    three numbers a labelled row. Labels that are null are left out; of several for one id the largest holds. Without labels of both kinds the model
    gives every text the base rate (0 without labels).
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    )
    train = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # bounded by `labelled`

    def sketches(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_sketch(t.as_py()) for t in b.column(2)], pa.int64())], ["doc_id", "label", "sketch"])

    single = train.select("doc_id", "label", "text").mapInArrow(sketches, "doc_id bigint, label int, sketch bigint").groupBy("sketch", "label").agg(F.min("doc_id").alias("doc_id"))
    single = [(r.doc_id, r.label) for r in single.collect()]  # at most `labelled` rows
    spark = docs.sparkSession
    positive = sum(y > 0 for _, y in single)
    negative = len(single) - positive
    if not positive or not negative:
        rate = positive / len(single) if single else 0.0
        return Model({}, [40.0 if rate == 1 else -40.0, 0.0, 0.0, 0.0])
    once = spark.createDataFrame(single, "doc_id bigint, label int")

    def counts(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for s in {w for w in map(bare, text.as_py().split()) if w}:
                    seen.setdefault(s, [0, 0])[y > 0] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["s", "no", "yes"])

    yes, no = F.col("yes") + 0.5, F.col("no") + 0.5
    odds = F.log(yes / (positive + 1)) - F.log(no / (negative + 1)) - F.sqrt(1 / yes + 1 / no)
    found = (
        texts(docs, id_col, text_col).join(F.broadcast(once), "doc_id").select("label", "text").mapInArrow(counts, "s string, no bigint, yes bigint")
        .groupBy("s").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .where(F.col("yes") >= DOCUMENTS)
        .withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    )
    lexicon = {r.s: r.odds for r in found.collect()}
    rows = evidence(train.select("doc_id", "text", "label"), lexicon, "label").select("e0", "e1", "e2", "label").collect()
    x = np.array([[1.0, r.e0, r.e1, r.e2] for r in rows])
    y = np.array([float(r.label > 0) for r in rows])
    return Model(lexicon, calibrated(x, y))


def calibrated(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps, first column the constant. More evidence must not lower a score: a feature that would goes."""
    used = list(range(x.shape[1]))
    while True:
        f = x[:, used]
        ridge = np.diag([0.01] + [0.1] * (len(used) - 1))
        w = np.zeros(len(used))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
            step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + ridge, f.T @ (p - y) + ridge @ w)
            w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if not (w[1:] < 0).any():
            break
        used.pop(1 + int(w[1:].argmin()))
    out = [0.0] * x.shape[1]
    for k, v in zip(used, w.tolist(), strict=True):
        out[k] = v
    return out


def evidence(t: DataFrame, lexicon: dict[str, float], *kept: str) -> DataFrame:
    """(doc_id, kept columns, e0, e1, e2) of rows with doc_id and text."""
    types = dict(t.dtypes)
    names = ["doc_id", *kept]

    def run(batches):
        reader = Reader(lexicon)
        for b in batches:
            e = [reader.evidence(s.as_py()) for s in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *(pa.array([v[i] for v in e], pa.float64()) for i in range(3))], [*names, "e0", "e1", "e2"])

    return t.select(*names, "text").mapInArrow(run, ", ".join([*(f"{n} {types[n]}" for n in names), "e0 double", "e1 double", "e2 double"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text; repeated rows and null ids too. Null and empty texts match nothing, so they get the score of no evidence."""
    w = model.weights
    z = F.lit(w[0]) + F.col("e0") * w[1] + F.col("e1") * w[2] + F.col("e2") * w[3]
    return evidence(texts(docs, id_col, text_col), model.lexicon).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"))


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score under limit; texts are read where they stand, and nothing is shuffled.

    Each row is judged by its own text alone: repeated rows go or stay together, null ids too. Null and empty texts score as no evidence and
    stay unless the base rate is over limit. Other columns may have any name. No rows give none.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        reader = Reader(model.lexicon)
        for b in batches:
            e = np.array([reader.evidence(s.as_py() or "") for s in b.column(at)]).reshape(-1, 3)
            yield b.filter(pa.array(model.score(e) < limit))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
