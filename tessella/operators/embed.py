"""Embeddings of entities: principal components, latent semantic indexing, non-negative factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import hashed_int
from tessella.sources.storage import cut

from .matrix import gene_moments, loading_embedding, log1p, normalize_total, tf_idf


def _gram(x: DataFrame) -> DataFrame:
    """Sums of products of every two genes over entities: one join on the entity, aggregated before the shuffle."""
    a, b = x.select("obs_id", F.col("gene").alias("a"), F.col("value").alias("va")), x.select("obs_id", F.col("gene").alias("b"), F.col("value").alias("vb"))
    return a.join(b, "obs_id").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))


#: Up to so many genes their moments (a number for every two) are decomposed on the driver.
GRAM_GENES = 1024


def _by_gram(x: DataFrame, genes: list[str], mean, n_rows: int, k: int):
    import numpy as np

    at = {g: i for i, g in enumerate(genes)}
    m = np.zeros((len(genes), len(genes)))
    for r in _gram(x).toLocalIterator():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.s
    values, vectors = np.linalg.eigh(m - n_rows * np.outer(mean, mean))
    return vectors[:, np.argsort(-values)[:k]]


def _by_iteration(x: DataFrame, genes: list[str], mean, n_rows: int, k: int, steps: int = 12, extra: int = 8, seed: int = 0):
    """Subspace iteration: a step is two aggregations, and brings k + ``extra`` numbers for each gene to the driver."""
    import numpy as np

    spark, at, c = x.sparkSession, {g: i for i, g in enumerate(genes)}, min(len(genes), k + extra)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(genes), c)))[0]
    for step in range(steps):
        load = spark.createDataFrame([(g, v[i].tolist()) for g, i in at.items()], "gene string, v array<double>")
        shift = mean @ v
        scores = x.join(F.broadcast(load), "gene").groupBy("obs_id").agg(*[(F.sum(F.col("value") * F.col("v")[j]) - float(shift[j])).alias(f"y{j}") for j in range(c)])
        z = np.zeros_like(v)
        for r in x.join(scores, "obs_id").groupBy("gene").agg(*[F.sum(F.col("value") * F.col(f"y{j}")).alias(f"y{j}") for j in range(c)]).toLocalIterator():
            z[at[r.gene]] = r[1:]
        if step + 1 < steps:
            v = np.linalg.qr(z)[0]
    small, turn = np.linalg.eigh((v.T @ z + z.T @ v) / 2)
    return (v @ turn)[:, np.argsort(-small)[:k]]


def components(x: DataFrame, n_rows: int, k: int, centred: bool = True, gram_genes: int = GRAM_GENES) -> tuple[DataFrame, DataFrame]:
    """Scores (obs_id, pc, value) and loadings (gene, pc, loading) of the ``k`` largest components.

    What reaches the driver is bounded by the genes: their moments for up to ``gram_genes`` of them, and beyond
    that k + 8 numbers for each gene in every step of a subspace iteration.  A component's sign makes its largest loading positive.
    """
    import numpy as np

    spark = x.sparkSession
    sums = {r.gene: r.s for r in x.groupBy("gene").agg(F.sum("value").alias("s")).collect()}
    genes = sorted(sums)
    mean = np.array([sums[g] for g in genes]) / n_rows if centred else np.zeros(len(genes))
    v = (_by_gram if len(genes) <= gram_genes else _by_iteration)(x, genes, mean, n_rows, k)
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    loadings = spark.createDataFrame([(g, j, float(v[i, j])) for i, g in enumerate(genes) for j in range(v.shape[1])], "gene string, pc int, loading double")
    scores = x.join(F.broadcast(loadings), "gene").groupBy("obs_id", "pc").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
    if centred:
        shift = spark.createDataFrame([(j, float(mean @ v[:, j])) for j in range(v.shape[1])], "pc int, shift double")
        scores = scores.join(F.broadcast(shift), "pc").select("obs_id", "pc", (F.col("value") - F.col("shift")).alias("value"))
    return scores, loadings


def latent_semantic(x: DataFrame, n_rows: int, k: int) -> DataFrame:
    """TF-IDF, singular vectors without the first, each scaled to [0, 1]."""
    from tessella.functions.stats import minmax

    scores, _ = components(tf_idf(x, n_rows), n_rows, k + 1, centred=False)
    return scores.where("pc > 0").withColumn("value", minmax("value", ["pc"]))


def non_negative(x: DataFrame, k: int, seed: int = 0, steps: int = 12, cut_every: int = 4) -> DataFrame:
    """Non-negative factors of entities, ``obs_id, pc, value``, by multiplicative updates; absent values are zeros.

    The genes' factors (k numbers for each gene) live on the driver and are broadcast; the entities' factors stay
    distributed, and their lineage is cut every few steps.  They start from hashes of the ids: the same in every run.
    """
    import numpy as np

    spark = x.sparkSession
    genes = sorted(r.gene for r in x.select("gene").distinct().collect())
    at = {g: i for i, g in enumerate(genes)}
    h = np.random.default_rng(seed).random((k, len(genes))) + 0.1
    names = [f"w{j}" for j in range(k)]
    start = [(F.lit(0.5) + hashed_int(8, seed, "obs_id", F.lit(str(j))) / float(16**8)).alias(n) for j, n in enumerate(names)]
    w = cut(x.select("obs_id").distinct().select("obs_id", *start), "factors")
    for step in range(steps):
        load = spark.createDataFrame([(g, h[:, i].tolist()) for g, i in at.items()], "gene string, h array<double>")
        pull = x.join(F.broadcast(load), "gene").groupBy("obs_id").agg(*[F.sum(F.col("value") * F.col("h")[j]).alias(f"_{n}") for j, n in enumerate(names)])
        hh = h @ h.T
        push = [sum((F.col(m) * float(hh[i, j]) for i, m in enumerate(names)), F.lit(1e-12)) for j in range(k)]
        w = w.join(pull, "obs_id").select("obs_id", *[(F.col(n) * F.col(f"_{n}") / push[j]).alias(n) for j, n in enumerate(names)])
        if (step + 1) % cut_every == 0 or step + 1 == steps:
            w = cut(w, "factors")
        if step + 1 == steps:
            break
        xw = np.zeros((k, len(genes)))
        for r in x.join(w, "obs_id").groupBy("gene").agg(*[F.sum(F.col("value") * F.col(n)) for n in names]).toLocalIterator():
            xw[:, at[r.gene]] = r[1:]
        ww = np.array(w.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).first()).reshape(k, k)
        h *= xw / (ww @ h + 1e-12)
    return w.unpivot("obs_id", names, "pc", "value").select("obs_id", F.substring("pc", 2, 9).cast("int").alias("pc"), "value")


#: Count processing by name.
NORMALISATIONS = {
    "log_norm": lambda x, n: log1p(normalize_total(x, ["obs_id"])),
    "tf_idf": tf_idf,
    "none": lambda x, n: x,
}
#: Embeddings by name: of processed counts, with the number of entities and of dimensions.
METHODS = {
    "pca": lambda x, n, k: components(x, n, k)[0],
    "pca_uncentred": lambda x, n, k: components(x, n, k, centred=False)[0],
    "loadings": lambda x, n, k: loading_embedding(x, components(x, n, k)[1]),
    "lsi": lambda x, n, k: components(x, n, k + 1, centred=False)[0].where("pc > 0"),
    "nmf": lambda x, n, k: non_negative(x, k),
}


def generate(expr: DataFrame, tiles: DataFrame, method: str = "pca", normalisation: str = "log_norm", dimensions: int = 30, n_top: int | None = None, sets: dict[str, list[str]] | None = None, scale: bool = True) -> DataFrame:
    """From counts and tiles (``px, py, obs_id``) to an embedded picture: ``px, py, obs_id, pc, value``.

    Counts are processed by name, reduced to the ``n_top`` genes of largest variance, and embedded by name; ``sets`` gives
    gene-set means instead (one dimension each).  An entity without values is 0 in every dimension.  ``scale`` maps
    each dimension to [0, 1] over the entities that have tiles.
    """
    if normalisation not in NORMALISATIONS or (sets is None and method not in METHODS):
        raise ValueError(f"unknown normalisation or method: {normalisation!r}, {method!r}")
    obs = tiles.select("obs_id").distinct()
    n = obs.count()
    x = NORMALISATIONS[normalisation](expr.join(obs, "obs_id", "left_semi"), n).select("obs_id", "gene", "value")
    if n_top is not None:
        top = gene_moments(x, n).orderBy(F.desc("variance"), "gene").limit(n_top)  # the best n genes
        x = x.join(F.broadcast(top.select("gene")), "gene", "left_semi")
    x = cut(x, "processed")
    if sets is not None:
        rows = [(g, i, 1.0 / len(genes)) for i, genes in enumerate(sets.values()) for g in genes]
        member = x.sparkSession.createDataFrame(rows, "gene string, pc int, w double")
        scores, dims = x.join(F.broadcast(member), "gene").groupBy("obs_id", "pc").agg(F.sum(F.col("value") * F.col("w")).alias("value")), len(sets)
    else:
        scores = METHODS[method](x, n, dimensions)
        first = scores.agg(F.min("pc")).first()[0] or 0
        scores, dims = scores.select("obs_id", (F.col("pc") - first).cast("int").alias("pc"), "value"), dimensions
    grid = obs.select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("pc"))
    full = grid.join(scores, ["obs_id", "pc"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if scale:
        ends = full.groupBy("pc").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        width = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
        full = full.join(F.broadcast(ends), "pc").select("obs_id", "pc", ((F.col("value") - F.col("_lo")) / width).alias("value"))
    return tiles.select("px", "py", "obs_id").join(full, "obs_id").select("px", "py", "obs_id", "pc", "value")
