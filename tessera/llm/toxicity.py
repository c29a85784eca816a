"""Toxicity scores from two class-conditional Kneser-Ney models that share their backoff.

Each word is a sequence of UTF-8 bytes between boundary marks. At the highest order each class has
its own discounted counts; below it both classes back off to one Kneser-Ney model whose continuation
counts come from all documents, labelled or not, so an expression that neither class has seen gets
the same shared mass in both and moves the comparison little. A document's evidence is the
length-normalised difference of its two log-likelihoods (per word), as it is and as the mean excess
over each of MARGINS, so that a few plainly toxic words in a long text still show. A logistic curve
turns these means into a score from 0 to 1; it is fitted on evidence out of sample: the training rows
are dealt into FOLDS by hash, and each row's evidence comes from counts without its own fold.

Counts cover all documents and grow with them, and the probabilities are computed by joins and
aggregates over them. Labels come from at most ``train_bound`` training rows (all, if fewer; beyond,
those with the smallest hash of doc_id). An n-gram whose context no training row holds is as likely
in both classes, so only the others make up the model that scores: its size is set by the training
rows. It is broadcast in parts of PART entries, one at a time; the order is the same at every size.

Null, empty and wordless texts have evidence 0 and the score of that evidence, very long ones are
scored whole. Labels null count as absent; of several labels of a doc_id the highest counts. Rows
repeat in the output as in the input, and extra columns may have any names. Without documents or
labels of both classes scores are one half or near it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import ALNUM, Words, give_back, lean, slices
from .workspace import Workspace, bound_batches

ORDER = 5
#: Entries of one broadcast part of the model (12 bytes each, while it is fitted 24).
PART = 1 << 22
TRAIN_BOUND = 1_000_000
FOLDS = 4
DISCOUNT = 0.75
#: A word's excess over each margin (in nats) is averaged over the words plus PRIOR_WORDS.
MARGINS, PRIOR_WORDS = (2, 4, 6), 20
#: Weight of the penalty on the logistic curve's slopes, in training rows.
RIDGE = 1e-4
_PAD = 32
_COUNTS = [f"{kind}{fold}" for kind in ("ordinary", "toxic") for fold in range(FOLDS)]


def _unique_words(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of one place of each distinct word, and for each word its distinct one."""
    _, at, which = np.unique(found.hashes(), return_index=True, return_inverse=True)
    return at, which


def gram_keys(found: Words, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (last byte lowest) of the words at ``at``, and the index of each one's word."""
    lengths = found.ends[at] - found.starts[at]
    blocks = lengths + order
    begin = np.cumsum(blocks) - blocks
    letters = np.full(int(blocks.sum()), _PAD, np.int64)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters[np.repeat(begin + order - 1, lengths) + inner] = found.data[np.repeat(found.starts[at], lengths) + inner]
    keys = np.zeros(max(len(letters) - order + 1, 0), np.int64)
    for j in range(order):
        keys = (keys << 8) | letters[j : j + len(keys)]
    owner = np.repeat(np.arange(len(at)), lengths + 1)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    return keys[np.repeat(begin, lengths + 1) + inner], owner


def _counter(order: int):
    """Each n-gram of the texts with its counts by class and fold; ``code`` is class * FOLDS + fold, or null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        most = 1 << 17

        def merged() -> np.ndarray:
            keys, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            out = np.zeros((1 + len(_COUNTS), len(keys)), np.int64)
            out[0] = keys
            for k in range(1, len(out)):
                column = np.concatenate([h[k] for h in held])
                if column.any():
                    out[k] = np.bincount(which, column, len(keys))
            return out

        for whole in batches:
            for batch in slices(whole):
                found = Words(batch.column(0), ALNUM)
                if not len(found.starts):
                    continue
                of_word = np.repeat(batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False), np.diff(found.bounds))
                at, which = _unique_words(found)
                keys, owner = gram_keys(found, at, order)
                rows = np.zeros((1 + len(_COUNTS), len(keys)), np.int64)
                rows[0] = keys
                for code in np.unique(of_word[of_word >= 0]).tolist():
                    rows[1 + code] = np.bincount(which, of_word == code, len(at))[owner]
                held.append(rows)
                if sum(h.shape[1] for h in held) > most:
                    held = [merged()]
                    most = max(most, 2 * held[0].shape[1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["gram", *_COUNTS])

    return count


def _last(column: str, order: int) -> Column:
    """The n-gram of the last ``order`` bytes."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * order)) - 1))


def shared_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``g, p``: Kneser-Ney probability of the last byte of each n-gram of ``order`` bytes, from how many
    different n-grams of ``order + 1`` bytes end in it.

    A context has at most 256 different next bytes, so its window is small.
    """
    levels, above = [], grams.select(F.col("gram").alias("g"))
    for k in range(order, 0, -1):
        above = above.groupBy(_last("g", k).alias("g")).agg(F.count("*").alias("fans"))
        levels.append(above)
    context = Window.partitionBy(F.shiftright("g", 8))
    out = levels.pop().select("g", (F.col("fans") / F.sum("fans").over(context)).alias("p"))
    for k in range(2, order + 1):
        level = levels.pop().select("g", "fans", F.sum("fans").over(context).alias("total"), F.count("*").over(context).alias("kinds"), _last("g", k - 1).alias("lower"))
        level = level.join(out.withColumnRenamed("g", "lower"), "lower")
        out = level.select("g", (F.greatest(F.col("fans") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("p")).alias("p"))
    return out


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """``gram, all, without0, ...``: log P(last byte | context, toxic) - log P(last byte | context, ordinary)
    from all counts, and from those without each fold. Only n-grams whose context a training row holds."""
    context = Window.partitionBy(F.shiftright("gram", 8))
    names = {"all": None} | {f"without{f}": f for f in range(FOLDS)}
    columns = ["gram"]
    for name, fold in names.items():
        for kind in ("toxic", "ordinary"):
            count = sum((F.col(f"{kind}{f}") for f in range(FOLDS) if f != fold), F.lit(0))
            columns += [count.alias(f"{kind}_{name}")]
    counted = grams.select(*columns)
    for name in names:
        for kind in ("toxic", "ordinary"):
            c = F.col(f"{kind}_{name}")
            counted = counted.withColumn(f"{kind}_{name}_total", F.sum(c).over(context)).withColumn(f"{kind}_{name}_kinds", F.count(F.when(c > 0, 1)).over(context))
    counted = counted.where("toxic_all_total + ordinary_all_total > 0").withColumn("g", _last("gram", order - 1)).join(shared_probabilities(grams, order - 1), "g")

    def likelihood(kind: str, name: str) -> Column:
        c, total, kinds = (F.col(f"{kind}_{name}{x}") for x in ("", "_total", "_kinds"))
        own = F.greatest(c - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1))
        rest = F.when(total > 0, DISCOUNT * kinds / F.greatest(total, F.lit(1))).otherwise(1.0)
        return F.log(own + rest * F.col("p"))

    return counted.select("gram", *[(likelihood("toxic", n) - likelihood("ordinary", n)).alias(n) for n in names])


@dataclass
class ToxicityModel:
    order: int
    parts: list = field(default_factory=list)  # broadcasts of (sorted n-grams, log ratios)
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * len(MARGINS)
    offset: float = 0.0

    def evidence(self, documents: DataFrame, keep_text: bool = True) -> DataFrame:
        """``kept`` (a struct of all columns but text) ``, text, evidence``: the mean log-likelihood ratio and excesses."""
        rest = [c for c in documents.columns if c != "text"]
        kept = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
        return _evidence(documents.select(kept.alias("kept"), F.col("text").cast("string").alias("text"), F.lit(0).alias("which")), self.parts, self.order, keep_text)

    def score(self, evidence: str = "evidence") -> Column:
        terms = [F.col(evidence)[k] * slope for k, slope in enumerate(self.slopes)]
        return 1 / (1 + F.exp(-(sum(terms) + self.offset)))


def _evidence(rows: DataFrame, parts: list, order: int, keep_text: bool) -> DataFrame:
    """Evidence of ``rows(kept, text, which)`` from column ``which`` of the parts; sums of words go from part to part."""
    kept = f"kept {rows.schema['kept'].dataType.simpleString()}"
    if len(parts) > 1:
        work = Workspace(rows.sparkSession, "toxicity")
        for part in parts[:-1]:
            done = rows.mapInArrow(lean(_scorer(part, order, False, True)), f"{kept}, text string, which int, sums array<double>")
            rows = work.save(done)  # one part at a time in a worker
    last = parts[-1] if parts else None
    return rows.mapInArrow(lean(_scorer(last, order, True, keep_text)), f"{kept}, {'text string, ' if keep_text else ''}evidence array<double>")


def _ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _scorer(part, order: int, final: bool, keep_text: bool):
    def word_ratios(found: Words, column: np.ndarray) -> np.ndarray:
        """The log ratio of every word, by this part; ``column`` says for each text which of the ratios count."""
        out = np.zeros(len(found.starts))
        if part is None or not len(out):
            return out
        grams, ratios = part.value
        at, which = _unique_words(found)
        keys, owner = gram_keys(found, at, order)
        place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        known = grams[place] == keys
        of_word = np.repeat(column, np.diff(found.bounds))
        for c in np.unique(column).tolist():
            of_kind = np.bincount(owner, np.where(known, ratios[c][place], 0.0), len(at))
            mine = of_word == c
            out[mine] = of_kind[which[mine]]
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = Words(batch.column(1), ALNUM)
                words = word_ratios(found, batch.column(2).to_numpy())
                if batch.num_columns > 3:
                    words = words + batch.column(3).flatten().to_numpy()
                if not final:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], _ragged(words, found.bounds)], names=["kept", "text", "which", "sums"])
                    continue
                means = np.zeros((found.rows, 1 + len(MARGINS)))
                size = np.diff(found.bounds) + PRIOR_WORDS
                for k, value in enumerate([words, *(np.maximum(words - m, 0) for m in MARGINS)]):
                    total = np.r_[0.0, np.cumsum(value)]
                    means[:, k] = (total[found.bounds[1:]] - total[found.bounds[:-1]]) / size
                evidence = _ragged(means.ravel(), np.arange(found.rows + 1) * means.shape[1])
                names = ["kept", "text", "evidence"] if keep_text else ["kept", "evidence"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], evidence], names=names)

    return score


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(documents: DataFrame, labels: DataFrame, train_bound: int = TRAIN_BOUND, order: int = ORDER, part: int | None = None) -> ToxicityModel:
    """Fit on ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    spark = documents.sparkSession
    bound_batches(spark)
    part = part or PART
    train = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_bound)
        .withColumn("fold", F.expr(f"cast(pmod(xxhash64(doc_id, 7), {FOLDS}) as int)"))
    )
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = docs.join(F.broadcast(train), "doc_id", "left").select("text", (F.col("label") * FOLDS + F.col("fold")).alias("code"))
    counted = marked.mapInArrow(lean(_counter(order)), f"gram long, {', '.join(f'{c} long' for c in _COUNTS)}")
    work = Workspace(spark, "toxicity")
    grams = work.save(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    ratios = work.save(log_ratios(grams, order))
    count = ratios.count()
    names = ["all", *(f"without{f}" for f in range(FOLDS))]
    fitted, scoring = [], []
    parts = -(-count // part)
    for k in range(parts):
        found = ratios.where(F.expr(f"pmod(xxhash64(gram), {parts}) = {k}")).orderBy("gram").toArrow()
        gram = found.column("gram").to_numpy()
        table = [found.column(c).to_numpy().astype(np.float32) for c in names]
        scoring.append(spark.sparkContext.broadcast((gram, table[:1])))
        fitted.append(spark.sparkContext.broadcast((gram, table[1:])))
        del found, gram, table
    work.drop(grams, ratios)
    model = ToxicityModel(order, scoring)
    rows = docs.join(F.broadcast(train), "doc_id").select(F.struct("label").alias("kept"), "text", F.col("fold").alias("which"))
    rows = _evidence(rows, fitted, order, False).select("kept.label", "evidence").toArrow()
    for b in fitted:
        b.unpersist()
    if rows.num_rows:
        x = np.array(rows.column("evidence").to_pylist())
        beta = _logistic(x, rows.column("label").to_numpy())
        model.slopes, model.offset = tuple(map(float, beta[:-1])), float(beta[-1])
    del rows
    give_back()
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of a logistic fit by damped Newton steps; both classes weigh the same."""
    scale = np.maximum(x.std(0), 1e-9)
    design = np.c_[x / scale, np.ones(len(x))]
    w = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    ridge = np.r_[np.full(x.shape[1], RIDGE), 1e-9]
    beta = np.zeros(design.shape[1])
    loss = lambda b: (w * np.logaddexp(0, -np.where(y > 0, 1, -1) * (design @ b))).sum() + (ridge * b * b).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        slope = design.T @ (w * ((y > 0) - p)) - ridge * beta
        step = np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    beta[:-1] /= scale
    return beta


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, mean_ratio`` of each row."""
    found = model.evidence(documents.select("doc_id", "text"), keep_text=False).select("kept.doc_id", "evidence")
    return found.select("doc_id", held_out().alias("held_out"), model.score().alias("score"), (model.score() >= threshold).cast("int").alias("predicted"), F.col("evidence")[0].alias("mean_ratio"))


def reject_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with their columns."""
    kept = model.evidence(documents).where(model.score() < threshold)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"kept.`{c}`") for c in documents.columns])
