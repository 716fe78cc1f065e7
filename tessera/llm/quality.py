"""Quality classifier: document evidence under hierarchical empirical Bayes priors.

A document speaks for itself through two log-likelihood ratios, for being of low
quality (a logistic regression on the style of its words and characters) and for
being toxic (a lexicon of words and word beginnings that labelled toxic texts
hold far more often than chance allows).  Its site speaks through rates of bad
documents: the global rate, the host's, and the path's within the host.  Rates
come from grouped aggregation of the documents' own posteriors, and each level
shrinks toward the one above by a strength estimated from how much the groups
differ (method of moments), so a site with few documents says little.  Evidence
and site prior add up in log odds.

The model is fitted on a bounded sample of labelled rows; scoring and the site
rates cover every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle, slices

#: Labelled rows that a model is fitted on, at most; that bounds its lexicon as well, which has every entry that is surprising enough.
MOST_LABELLED = 20_000
#: A document is rejected at this posterior of either fault.
REJECT = 0.5
#: Letters of the word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5)
#: Share of a lexicon entry's documents that must be toxic.
PRECISION = 0.9
STYLE = ("log_words", "upper", "symbols", "bangs", "bars", "repeats", "distinct", "word_length", "digits", "top_share")
_WORD = re.compile(r"\w+")
#: Two letters of Han or kana, which are written without blanks: a word of such texts.
_UNSPACED = re.compile(r"([\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2})(?=\w)")
_PLAIN = ".,;:'\"-()?!"
_PLAIN_WIDE = "、。「」『』・" + "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)  # of Han, kana and Hangul texts
#: Code points that most texts stay below, and the end of all.
_COMMON, _ALL = 0x3000, 0x110000


@cache
def _character_kinds(end: int) -> np.ndarray:
    kinds = np.full(end, 1, np.uint8)  # 1: any other letter
    for code in range(len(kinds)):
        c = chr(code)
        if c.isupper():
            kinds[code] = 2
        elif c.isdigit():
            kinds[code] = 3
        elif c.isspace():
            kinds[code] = 0
        elif not c.isalnum():
            kinds[code] = 4 if c in _PLAIN or c in _PLAIN_WIDE else 5
    return kinds


def style(text: str) -> list[float]:
    """Numbers of STYLE for a whole text; all zero where it has no words."""
    words = text.split()
    if not words:
        return [0.0] * len(STYLE)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    common = codes.max() < _COMMON
    if not common:
        words = _UNSPACED.sub(r"\1 ", text).split()
    n = np.bincount(_character_kinds(_COMMON if common else _ALL)[codes], minlength=6)
    letters, shown = max(1, n[1] + n[2]), max(1, len(codes) - n[0])
    distinct = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(len(words)),
        n[2] / letters,
        n[5] / shown,
        text.count("!") / len(words),
        text.count("|") / len(words),
        repeats / len(words),
        len(distinct) / len(words),
        shown / len(words) / 10,
        n[3] / shown,
        max(distinct.values()) / len(words),
    ]


def lexical(text: str) -> set[str]:
    """Words of a text and their beginnings (marked by a final hyphen)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "-" for k in BEGINNINGS for w in words if len(w) > k}


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STYLE)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STYLE)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(STYLE)))
    bias: float | None = None  # None: no opinion on quality
    low_rate: float = 0.1
    toxic_rate: float = 0.1
    lexicon: dict[str, float] = field(default_factory=dict)
    silent: float = 0.0  # log-likelihood ratio of a text without an entry

    def evidence(self, text: str) -> tuple[float, float]:
        """Log-likelihood ratios of low quality and of toxicity."""
        low = 0.0
        if self.bias is not None:
            z = float((np.array(style(text)) - self.mean) / self.scale @ self.weights) + self.bias
            low = min(30.0, max(-30.0, z)) - math.log(self.low_rate / (1 - self.low_rate))
        found = -math.inf
        if self.lexicon:
            get, a, b = self.lexicon.get, *BEGINNINGS
            for w in set(_WORD.findall(text.lower())):
                for key in (w, w[:a] + "-", w[:b] + "-"):
                    if (value := get(key)) is not None and value > found:
                        found = value
        return low, found if found > -math.inf else self.silent


def _rate(bad: float, n: float) -> float:
    return (bad + 0.5) / (n + 1.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + penalty, x1.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most_labelled`` labelled rows, chosen by a hash of their doc_id.

    ``labels`` has doc_id, quality (1 good, 0 low) and toxic (1, 0); a null label
    leaves its row out of that part.  Without labels the model has no opinion.
    Of several texts under one doc_id that with the least hash is read, so the
    bound holds for texts as well.
    """
    chosen = labels.where("doc_id is not null").select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("draw"), "text")).alias("first")).select("doc_id", "first.text")
    texts = settle(found.join(F.broadcast(chosen), "doc_id"), "labelled")
    model = Model()
    n = texts.agg(F.count("quality"), F.sum(1 - F.col("quality")), F.count("toxic"), F.sum("toxic")).first()
    if n[2] and n[3]:
        model.toxic_rate = pi = _rate(n[3], n[2])

        def words(batches):
            for batch in (part for whole in batches for part in slices(whole, 0)):
                seen, bad = Counter(), Counter()
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    entries = lexical(text)
                    seen.update(entries)
                    if toxic:
                        bad.update(entries)
                yield pa.record_batch({"w": pa.array(list(seen), pa.string()), "bad": pa.array([bad[w] for w in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

        counted = texts.where("toxic is not null").select("text", "toxic").mapInArrow(words, "w string, bad long, n long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        counted = settle(counted, "lexicon")
        kinds = counted.count()
        # how unlikely so many toxic documents would be if the entry meant nothing (decimal digits)
        share = F.col("bad") / F.col("n")
        surprise = (F.col("bad") * F.log10(share / pi) + F.when(F.col("bad") < F.col("n"), (F.col("n") - F.col("bad")) * F.log10((1 - share) / (1 - pi))).otherwise(0.0)).alias("surprise")
        found = counted.where(share > PRECISION).select("w", "bad", "n", surprise).where(F.col("surprise") > math.log10(max(kinds, 1)) + 2)
        good = n[2] - n[3]
        for w, bad, k, _ in found.collect():
            model.lexicon[w] = math.log((bad + pi) / (n[3] + 1)) - math.log((k - bad + 1 - pi) / (good + 1))

    bare = Model(lexicon=model.lexicon, silent=-1e9)

    def styles(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            said = [bare.evidence(t)[1] > -1e8 for t in texts]
            yield pa.record_batch({"style": pa.array([style(t) for t in texts], pa.list_(pa.float64())), "said": pa.array(said), "quality": batch.column(1).cast(pa.int32()), "toxic": batch.column(2).cast(pa.int32())})

    rows = texts.select("text", "quality", "toxic").mapInArrow(styles, "style array<double>, said boolean, quality int, toxic int").collect()
    quality = [(r["style"], 1 - r["quality"]) for r in rows if r["quality"] is not None]
    if quality and 0 < sum(y for _, y in quality) < len(quality):
        x, y = np.array([s for s, _ in quality]), np.array([y for _, y in quality], float)
        model.low_rate = _rate(y.sum(), len(y))
        model.mean, model.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        model.weights, model.bias = _logistic((x - model.mean) / model.scale, y)
    if model.lexicon:
        silent = [r["toxic"] for r in rows if r["toxic"] is not None and not r["said"]]
        model.silent = math.log((sum(silent) + 0.5) / (n[3] + 1)) - math.log((len(silent) - sum(silent) + 0.5) / (n[2] - n[3] + 1))
    return model


def _log_odds(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _posterior(rate, evidence: str):
    return 1 / (1 + F.exp(-(_log_odds(rate) + F.col(evidence))))


def _strength(groups: DataFrame, bad: str, above) -> float:
    """Pseudo-documents of the level above: m (1 - m) / spread between groups, less one."""
    rate = F.col(bad) / F.col("n")
    got = groups.agg(
        F.sum(F.col("n") * F.pow(rate - above, 2)) / F.sum("n"), F.sum(F.col(bad)) / F.sum("n"), F.count("*") / F.sum("n")
    ).first()
    if got[1] is None:
        return 1e6
    m = min(max(got[1], 1e-6), 1 - 1e-6)
    spread = got[0] - m * (1 - m) * got[2]  # without what sampling alone would give
    return min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6


def site_rates(scored: DataFrame, model: Model) -> DataFrame:
    """host, path, low_prior, toxic_prior for every site of ``scored``."""
    priors = {"low": model.low_rate, "toxic": model.toxic_rate}
    sums = [F.sum(_posterior(F.lit(float(p)), k)).alias(k) for k, p in priors.items()]
    paths = settle(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = settle(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")), "hosts")
    top = hosts.agg(F.sum("low") / F.sum("n"), F.sum("toxic") / F.sum("n")).first()
    whole = {"low": top[0] if top[0] is not None else 0.5, "toxic": top[1] if top[1] is not None else 0.5}
    for kind, rate in whole.items():
        k = _strength(hosts, kind, F.lit(rate))
        hosts = hosts.withColumn(f"host_{kind}", (F.col(kind) + k * rate) / (F.col("n") + k))
    hosts = hosts.select(F.col("host").alias("of"), "host_low", "host_toxic")
    both = settle(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "site-rates")
    for kind in whole:
        k = _strength(both, kind, F.col(f"host_{kind}"))
        both = both.withColumn(f"{kind}_prior", (F.col(kind) + k * F.col(f"host_{kind}")) / (F.col("n") + k))
    return both.select("host", "path", "low_prior", "toxic_prior")


def classify(docs: DataFrame, model: Model, *, host=None, path=None, keep_columns: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the kept columns), p_low_quality, p_toxic, keep for every row of ``docs``.

    ``host`` and ``path`` are columns that name a document's site, by default
    source and lang; null is a site of its own.  A null text counts as the empty
    one, which has its style (all zero) as evidence.  An empty table gives an
    empty one; repeated rows get equal scores.
    """
    host, path = (F.col("source") if host is None else host), (F.col("lang") if path is None else path)
    kept = F.struct(*[docs[c] for c in keep_columns or docs.columns]).alias("row")
    rows = docs.select(kept, host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def score(batches):
        for batch in batches:
            found = [model.evidence(t) for t in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.record_batch(columns, names=["row", "host", "path", "low", "toxic"])

    shape = f"row {rows.schema['row'].dataType.simpleString()}, host string, path string, low double, toxic double"
    scored = settle(rows.mapInArrow(score, shape), "evidence")
    rates = site_rates(scored, model).select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "low_prior", "toxic_prior")
    joined = scored.join(rates, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    out = joined.select("row", _posterior(F.col("low_prior"), "low").alias("p_low_quality"), _posterior(F.col("toxic_prior"), "toxic").alias("p_toxic"))
    return out.withColumn("keep", (F.col("p_low_quality") < REJECT) & (F.col("p_toxic") < REJECT))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, keep for every row of ``docs``."""
    scored = classify(docs, fit(docs, labels), keep_columns=["doc_id"])
    return scored.select("row.doc_id", "p_low_quality", "p_toxic", "keep")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged."""
    kept = classify(docs, fit(docs, labels)).where("keep")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
