"""Quality classifier by co-training of two views.

One view sees the text itself, the other only what is known about the page. Each is a logistic
regression. Round by round each labels the unlabelled documents it is surest of, out of all,
and these join the other's training rows. Both are calibrated (Platt) on labelled rows kept out
of training, and their log odds add up, the prior counted once. Fitting uses about MOST_LABELLED
labelled documents, drawn by a seeded hash of doc_id, and the surest ROUNDS * 4 * SURE others.
Features are JVM expressions, computed once per document and stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, stored, table, word_count

#: Bound of the labelled sample, rounds, pseudo-labels a round, view and class, log odds from
#: which a document is sure, and the sample's seed.
MOST_LABELLED, ROUNDS, SURE, SURE_FROM, SEED = 8_000, 4, 200, 3.0, 20240607
#: A document is kept unless the chance that it is good is below this.
KEEP_FROM = 0.2
LANGS = ("de", "en", "es", "fr")


def _share(part: Column, whole: Column) -> Column:
    """part of whole, drawn towards 0 where the whole is small."""
    return part / (whole + 8)


def _doubled(words: Column) -> Column:
    """How many words equal the word before them."""
    same = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))


def text_features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n, words = F.length(t), word_count(text)
    upper, letters = F.length(F.regexp_replace(t, r"\P{Lu}+", "")), F.length(F.regexp_replace(t, r"\P{L}+", ""))
    count = lambda chars: n - F.length(F.translate(t, chars, ""))
    return {
        "upper": _share(upper, letters),
        "letters": _share(letters, n),
        "digits": _share(count("0123456789"), n),
        "marks": _share(count("!?"), words),
        "signs": _share(count("#$%&*+=@\\^_`~<>{}[]"), words),
        "bars": _share(count("|"), words),
        "stops": _share(count(".,;:"), words),
        "word_length": F.least(_share(n, words), F.lit(30)) / 10,
        "doubled": _share(_doubled(F.split(t, rf"{BLANK}+")), words),
    }


def page_features(df_cols: set[str]) -> dict[str, Column]:
    """What is known besides the words: size, lines, language, source."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n, lines = F.length(t), 1 + F.length(t) - F.length(F.translate(t, "\n", ""))
    out = {"log_chars": F.log1p(n.cast("double")) / 10, "line_length": F.log1p(n / lines) / 10}
    for x in LANGS if "lang" in df_cols else ():
        out[f"lang_{x}"] = F.coalesce((F.col("lang") == x).cast("double"), F.lit(0.0))
    if "source" in df_cols:
        slot = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(8))
        out |= {f"source_{i}": (slot == i).cast("double") for i in range(8)}
    return out


@dataclass
class Linear:
    """w·(x - mean)/scale + b, then Platt: log odds = slope * z + shift."""

    w: np.ndarray
    b: float
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def column(self, features: list[Column], calibrated: bool = True) -> Column:
        z = F.lit(float(self.b))
        for w, m, s, c in zip(self.w, self.mean, self.scale, features, strict=True):
            z = z + (c - F.lit(float(m))) * F.lit(float(w / s))
        return z * F.lit(float(self.slope)) + F.lit(float(self.shift)) if calibrated else z


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with an unpenalised constant in front."""
    x = np.column_stack([np.ones(len(x)), x])
    w, k = np.zeros(x.shape[1]), np.ones(len(x)) if weights is None else weights
    fine = ridge * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (k * p * (1 - p))) @ x + np.diag(fine) + 1e-9 * np.eye(len(w)), x.T @ (k * (y - p)) - fine * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Linear:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = _newton((x - mean) / scale, y, 1.0, weights)
    return Linear(w[1:], float(w[0]), mean, scale)


#: The surest free documents of a view's model: (view, model, how many) -> (doc_ids, features)
#: of the lowest and of the highest, each with the model's raw odds in order.
Surest = Callable[[int, Linear, int], tuple[list[tuple], list[tuple]]]


def co_train(views: list[np.ndarray], y: np.ndarray, surest: Surest, rounds: int = ROUNDS, sure: int = SURE) -> tuple[list[Linear], float]:
    """A calibrated model for each view, and the prior log odds. y: 0 or 1 for the rows of views.
    surest() gives rows (odds, doc_id, features of both views).

    With one class only, or no labelled row, both models are constant.
    """
    n = len(y)
    if n < 8 or y.min() == y.max():
        odds = float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0
        return [Linear(np.zeros(v.shape[1]), 0.0, np.zeros(v.shape[1]), np.ones(v.shape[1]), 0.0, odds) for v in views], odds
    held = np.arange(n) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(n, bool)
    rows, ys, ws = [[v[~held]] for v in views], [[y[~held]], [y[~held]]], [[np.ones((~held).sum())] for _ in views]
    split, taken, models = views[0].shape[1], set(), []
    for step in range(rounds + 1):
        models = [_fit(np.concatenate(rows[i]), np.concatenate(ys[i]), np.concatenate(ws[i])) for i in (0, 1)]
        if step == rounds:
            break
        for i in (0, 1):
            for label, found in enumerate(surest(i, models[i], sure + len(taken))):
                picked = [(doc, f) for z, doc, f in found if abs(z) > SURE_FROM and (z > 0) == (label == 1) and doc not in taken][:sure]
                if picked:
                    taken.update(doc for doc, _ in picked)
                    f = np.array([f for _, f in picked])
                    rows[1 - i].append(f[:, split:] if i == 0 else f[:, :split])
                    ys[1 - i].append(np.full(len(picked), label))
                    ws[1 - i].append(np.full(len(picked), 0.5))
    on = held if held.any() else np.ones(n, bool)
    for m, v in zip(models, views, strict=True):
        m.shift, m.slope = _newton(m.raw(v[on])[:, None], y[on], 0.05)
        m.shift, m.slope = float(m.shift), float(max(0.0, m.slope))
    return models, float(np.log(y.mean() / (1 - y.mean())))


def score_quality(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most_labelled: int = MOST_LABELLED, seed: int = SEED, keep: Sequence[str] | None = None) -> DataFrame:
    """The documents with p_text, p_page, score (chances that a document is good) and keep.

    A null or empty text, or one without words, is no evidence and scores the prior. Label rows
    without a doc_id, whose quality isn't 0 or 1, or that contradict each other are passed over;
    equal ones count once. Rows repeat as in the input; for the fit a doc_id counts once, with
    the least of its features, and one without a doc_id not at all. Without labels of both
    classes every document has the same score and is kept. An empty table gives an empty result.
    All columns of documents stay, or those that `keep` names; of the four added names,
    documents' own give way.
    """
    own = [c for c in (documents.columns if keep is None else keep) if c not in ("p_text", "p_page", "score", "keep")]
    text, page = text_features(F.col("text")), page_features(set(documents.columns))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = documents.select(F.struct(*own).alias("row"), F.col("doc_id").alias("id"), worded.alias("worded"), F.array(*[c.cast("double") for c in [*text.values(), *page.values()]]).alias("f"))
    rows = stored(rows, "quality-features")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z")
    share = int(most_labelled / max(most_labelled, known.count()) * (1 << 30))
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share).select("id", "y")  # about most_labelled at most
    sample = rows.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("f").alias("f"), F.min("y").alias("y")).collect()
    sample.sort(key=lambda r: r.id)
    k, n = len(text), len(text) + len(page)
    x, y = np.array([r.f for r in sample], float).reshape(-1, n), np.array([r.y for r in sample], int)
    pool = rows.filter("worded AND id IS NOT NULL").join(known, "id", "left_anti").select("id", "f")
    part = (range(k), range(k, n))

    def surest(view: int, model: Linear, most: int) -> tuple[list[tuple], list[tuple]]:
        odds = pool.select(model.column([F.col("f")[j] for j in part[view]], calibrated=False).alias("z"), "id", "f")
        ends = [odds.filter(test).groupBy("id").agg(F.min(F.struct(order.alias("o"), F.col("f"), F.col("z"))).alias("b")).orderBy("b.o", "id").limit(most).collect() for test, order in ((F.col("z") < -SURE_FROM, F.col("z")), (F.col("z") > SURE_FROM, -F.col("z")))]
        return tuple([(r.b.z, r.id, r.b.f) for r in end] for end in ends)  # each a top k

    models, prior = co_train([x[:, :k], x[:, k:]], y, surest, rounds)
    chance = lambda z: 1 / (1 + F.exp(-z))
    odds = [F.when(F.col("worded"), m.column([F.col("f")[j] for j in at])).otherwise(F.lit(prior)) for m, at in zip(models, part, strict=True)]
    out = rows.select("row", odds[0].alias("t"), odds[1].alias("p")).withColumn("s", chance(F.col("t") + F.col("p") - F.lit(prior)))
    return out.select("row.*", chance(F.col("t")).alias("p_text"), chance(F.col("p")).alias("p_page"), F.col("s").alias("score"), (F.col("s") >= KEEP_FROM).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the chances by text, by page and together, and whether it is kept."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.select("doc_id", F.round("p_text", 6).alias("p_text"), F.round("p_page", 6).alias("p_page"), F.round("score", 6).alias("score"), "keep")
