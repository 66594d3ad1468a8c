"""Vector ranking, classification, centroids, similarity groups and fusion of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, literal, normalised, rounded, strict_dot
from tessera.operators.clustering import register_faces
from tessera.operators.means import element_means
from tessera.operators.order_statistics import nearest_rank
from tessera.operators.ranking import fuse, fuse_and_hydrate, keyword_lane, query_kind, rank_absolute, rank_relative, ranking_metrics
from tessera.operators.similarity import centroids, complete_linkage_of_vectors, nearest_centroid, similar_classes, similar_pairs, widest_dimensions
from tessera.sources.tables import table
from tessera.sources.views import PHOTOS_SQL, photos

EXCLUDE_MARGIN = 0.005


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _vector(spark: SparkSession, sf_dir: str, key: int) -> list[float]:
    """A query vector, taken from the table as an encoder would return it."""
    return [float(x) for x in _vectors(spark, sf_dir).where(F.col("vec_id") == key).first()["embedding"]]


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: rounded(F.col(c)) for c in columns})


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank_absolute(_vectors(spark, sf_dir), _vector(spark, sf_dir, 3), 50, 0.05), "score")


def cosine_rel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank_relative(_vectors(spark, sf_dir), _vector(spark, sf_dir, 7), 300, 0.02, min_lift=0.1), "rel")


def cosine_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two rows of a label."""
    return _rounded(rank_relative(_vectors(spark, sf_dir), _vector(spark, sf_dir, 11), 100, 0.0, per_group=2, group="label"), "rel")


def image_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative ranking divided by its peak, the query itself left out."""
    rows = rank_relative(_vectors(spark, sf_dir), _vector(spark, sf_dir, 5), 101, 0.0).where("vec_id <> 5")
    peak = rows.agg(F.max("rel").alias("peak"))
    return rows.crossJoin(peak).select("vec_id", F.round(F.col("rel") / F.col("peak"), 6).alias("score"))


def centered_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine after the mean of the library is taken off; the mean is one row."""
    v = _vectors(spark, sf_dir)
    means = element_means(v.withColumn("all", F.lit(0)), "all")
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("mean"))
    off = v.crossJoin(mean).select("vec_id", normalised(F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m)).alias("e"))
    query = off.where("vec_id = 3").select(F.col("e").alias("q"))
    scored = off.crossJoin(query).select("vec_id", dot(F.col("e"), F.col("q")).alias("score"))
    return _rounded(scored.orderBy(F.desc("score"), "vec_id").limit(40), "score")


def neutral_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each vector to seven neutral ones."""
    neutral = [_vector(spark, sf_dir, k) for k in range(1, 8)]
    e = F.col("embedding")
    base = sum((strict_dot(e, literal(n)) for n in neutral[1:]), strict_dot(e, literal(neutral[0]))) / len(neutral)
    return _vectors(spark, sf_dir).select("vec_id", rounded(base).alias("base"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, score, keyword, kept): best of four keywords above the mean of three neutral vectors, less two exclusions."""
    e = F.col("embedding")

    def cosines(keys: list[int]) -> list[Column]:
        return [dot(e, literal(_vector(spark, sf_dir, k))) for k in keys]

    words, neutral, excluded = [20, 21, 22, 23], cosines([1, 2, 3]), cosines([30, 31])
    positive = cosines(words)
    best, base = F.greatest(*positive), (neutral[0] + neutral[1] + neutral[2]) / 3
    keyword = F.coalesce(*(F.when(p == best, F.lit(k)) for p, k in zip(positive, words)))
    kept = (best - base >= 0.1) & (F.greatest(*excluded) < best - EXCLUDE_MARGIN)
    return _vectors(spark, sf_dir).select("vec_id", (best - base).alias("score"), keyword.alias("keyword"), kept.alias("kept"))


def keyword_argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_classified(spark, sf_dir).where("kept").drop("kept"), "score")


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, percentiles and maximum of the scores of one category."""
    scored = _classified(spark, sf_dir)
    p50, p90, p99 = nearest_rank(scored, "score", [0.5, 0.9, 0.99])
    return scored.agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top")).select(
        "n", "top", *(F.lit(round(v, 6)).alias(name) for name, v in (("p50", p50), ("p90", p90), ("p99", p99)))
    )


def dominant_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


def embedding_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.coalesce(F.max("vec_id"), F.lit(0)).alias("version"))


def max_variance_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(widest_dimensions(_vectors(spark, sf_dir), 3), 1)), "place int, dim int")


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(_vectors(spark, sf_dir)).select("label", F.posexplode("centroid").alias("pos", "c")).select("label", "pos", rounded(F.col("c")).alias("c"))


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _rounded(nearest_centroid(v, centroids(v), 0.2), "sim")


def representative_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each label closest to its centroid, least key on ties."""
    v = _vectors(spark, sf_dir)
    scored = v.join(centroids(v), "label").select("label", "vec_id", rounded(dot(F.col("embedding"), F.col("centroid"))).alias("sim"))
    best = scored.groupBy("label").agg(F.min(F.struct((-F.col("sim")).alias("s"), "vec_id")).alias("b"))
    return best.select("label", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("sim"))


def similar_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similar_pairs(_vectors(spark, sf_dir), 0.38), "sim")


def similar_vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of similar vectors with the number of links of each, beside the pairs."""
    return similar_classes(_vectors(spark, sf_dir), 0.38)


def complete_linkage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_linkage_of_vectors(_vectors(spark, sf_dir), 0.3)


def label_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as faces, their label the owner, every tenth of marginal quality."""
    return _vectors(spark, sf_dir).select(
        F.col("label").cast("long").alias("owner"), F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 10 == 9, "marginal").otherwise("ok").alias("verdict")
    )


def online_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(register_faces(label_faces(spark, sf_dir), 0.2), "sim")


def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the texts that users could type, one of twelve patterns around the words of each conversation turn."""
    patterns = ["2019年6月", "春天的花", "杭州西湖景区", "合同扫描", "猫", "Paper notes", "去年", "", "year 2020", "12月", "document scan", "公园里的狗"]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(*map(F.lit, patterns)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12)).cast("int") + 1).alias("p"), "role")
    return rows.select("conv_id", "turn", query_kind(F.concat_ws(" ", "p", "role")).alias("kind"))


def _lanes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = _vectors(spark, sf_dir)

    def ranked(rows: DataFrame, *order: Column) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("vec_id", "rank")

    kw = ranked(v.where("label = 3").orderBy(F.desc("vec_id")).limit(40), F.desc("vec_id"))
    img = ranked(rank_relative(v, _vector(spark, sf_dir, 2), 60, 0.0), F.desc("rel"), F.col("vec_id"))
    desc = ranked(rank_relative(v, _vector(spark, sf_dir, 4), 50, 0.0), F.desc("rel"), F.col("vec_id"))
    return {"kw": kw, "img": img, "desc": desc}


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fuse(_lanes(spark, sf_dir), "object", "vec_id").select("vec_id", "score", "place"), "score")


def fused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list with the columns of its rows; those of three labels are no longer there."""
    rows = _vectors(spark, sf_dir).where("label not in (1, 2, 5)").select("vec_id", "label")
    return _rounded(fuse_and_hydrate(_lanes(spark, sf_dir), rows, "object", "vec_id"), "score")


def keyword_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of a keyword, some without a time."""
    rows = photos(spark, sf_dir).select("id", "path", F.when(F.col("tone") != "P", F.col("shoot_time")).otherwise("").alias("shoot_time"))
    return keyword_lane(rows, "path", "Nation_1", "shoot_time", "id").select("id", "place")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and nDCG at 10 of the fused list for rows of two labels taken as relevant."""
    ranked = fuse(_lanes(spark, sf_dir), "date", "vec_id").select(F.lit("q").alias("query"), "vec_id", "place")
    relevant = _vectors(spark, sf_dir).where("label in (3, 4)").select(F.lit("q").alias("query"), "vec_id")
    return _rounded(ranking_metrics(ranked, relevant, "vec_id", 10), "precision", "recall", "ndcg")


def judged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the first twenty of each lane."""
    lanes = list(_lanes(spark, sf_dir).values())
    return lanes[0].union(lanes[1]).union(lanes[2]).where("rank < 20").select("vec_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        cosine_topk, cosine_rel_median, cosine_fold, image_recall, centered_cosine, neutral_baseline, keyword_argmax_class, percentile_nearest_rank, dominant_model,
        embedding_version, max_variance_dims, centroid_by_label, nearest_label, representative_member, similar_vector_pairs, similar_vector_classes, complete_linkage_groups,
        online_clustering, query_kinds, rrf_fusion, fused_rows, keyword_places, retrieval_metrics, judged_pool,
    )
}


def _score(key: int, name: str = "s") -> str:
    """Scores of all vectors against one of them."""
    return f"{name} AS (SELECT e.vec_id, e.label, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id = {key})"


def _rel(key: int, limit: int, name: str, floor: float = 0.0) -> str:
    return f"""{_score(key, 's' + name)}, {name} AS (SELECT vec_id, label, score - (SELECT median(score) FROM s{name}) AS rel FROM s{name}
        WHERE score - (SELECT median(score) FROM s{name}) >= {floor} ORDER BY rel DESC, vec_id LIMIT {limit})"""


def _cos(key: int) -> str:
    return f"list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {key})::DOUBLE[])"


_CLASS = f"""c AS (SELECT vec_id, list_sort([{', '.join(f"({_cos(k)}, -{k})" for k in (20, 21, 22, 23))}]) AS p,
    ({' + '.join(_cos(k) for k in (1, 2, 3))}) / 3 AS base, greatest({_cos(30)}, {_cos(31)}) AS worst FROM embeddings),
    k AS (SELECT vec_id, p[4][1] - base AS score, (-p[4][2])::INT AS keyword, p[4][1] AS best, worst FROM c)"""
_CENTROID = """f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    m AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS len FROM m GROUP BY 1),
    cent AS (SELECT label, list(m / len ORDER BY pos) AS centroid FROM m JOIN n USING (label) GROUP BY 1)"""
_LANES = f"""kw AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS rank FROM embeddings WHERE label = 3 ORDER BY vec_id DESC LIMIT 40),
    {_rel(2, 60, 'ri')}, {_rel(4, 50, 'rd')}, img AS (SELECT vec_id, row_number() OVER (ORDER BY rel DESC, vec_id) - 1 AS rank FROM ri),
    dsc AS (SELECT vec_id, row_number() OVER (ORDER BY rel DESC, vec_id) - 1 AS rank FROM rd)"""


def _fused(w_img: float, w_desc: float, primary: str) -> str:
    return f"""u AS (SELECT vec_id, 'kw' AS lane, rank, 1.0 / (61 + rank) AS part FROM kw UNION ALL SELECT vec_id, 'img', rank, {w_img} / (61 + rank) FROM img
      UNION ALL SELECT vec_id, 'desc', rank, {w_desc} / (61 + rank) FROM dsc),
    g AS (SELECT vec_id, sum(part::DOUBLE) AS score, min(rank) FILTER (lane = 'kw') AS kr, max((lane = '{primary}')::INT) AS ph FROM u GROUP BY 1),
    fused AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, kr ASC NULLS LAST, ph DESC, vec_id)::INT AS place FROM g)"""


ORACLES = {
    "cosine_topk": f"WITH {_score(3)} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, vec_id LIMIT 50",
    "cosine_rel_median": f"WITH {_rel(7, 300, 'r', 0.02)} SELECT vec_id, round(rel, 6) AS rel FROM r",
    "cosine_fold": f"""WITH {_score(11)}, r AS (SELECT vec_id, label, score - (SELECT median(score) FROM s) AS rel FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rel DESC, vec_id) AS rn FROM r WHERE rel >= 0) SELECT vec_id, round(rel, 6) AS rel FROM n WHERE rn <= 2 ORDER BY n.rel DESC, vec_id LIMIT 100""",
    "image_recall": f"WITH {_rel(5, 101, 'r')}, o AS (SELECT * FROM r WHERE vec_id <> 5) SELECT vec_id, round(rel / (SELECT max(rel) FROM o), 6) AS score FROM o",
    "centered_cosine": """WITH f AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT pos, avg(x) AS m FROM f GROUP BY 1),
        d AS (SELECT vec_id, list(x - m ORDER BY pos) AS e FROM f JOIN m USING (pos) GROUP BY 1), q AS (SELECT e FROM d WHERE vec_id = 3),
        s AS (SELECT vec_id, list_inner_product(d.e, q.e) / sqrt(list_inner_product(d.e, d.e)) / sqrt(list_inner_product(q.e, q.e)) AS score FROM d, q)
        SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 40""",
    "neutral_baseline": f"SELECT vec_id, round(({' + '.join(_cos(k) for k in range(1, 8))}) / 7, 6) AS base FROM embeddings",
    "keyword_argmax_class": f"WITH {_CLASS} SELECT vec_id, round(score, 6) AS score, keyword FROM k WHERE score >= 0.1 AND worst < best - {EXCLUDE_MARGIN}",
    "percentile_nearest_rank": f"""WITH {_CLASS}, l AS (SELECT list(score ORDER BY score) AS v, count(*) AS n FROM k)
        SELECT n, round(v[n], 6) AS top, round(v[floor((n - 1) * 0.5 + 0.5)::INT + 1], 6) AS p50, round(v[floor((n - 1) * 0.9 + 0.5)::INT + 1], 6) AS p90,
        round(v[floor((n - 1) * 0.99 + 0.5)::INT + 1], 6) AS p99 FROM l""",
    "dominant_model": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, label LIMIT 1",
    "embedding_version": "SELECT label, count(*) AS n, max(vec_id) AS version FROM embeddings GROUP BY 1",
    "max_variance_dims": """WITH f AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), v AS (SELECT dim, var_pop(x) AS v FROM f GROUP BY 1)
        SELECT row_number() OVER (ORDER BY v DESC, dim)::INT AS place, dim::INT AS dim FROM v QUALIFY place <= 3""",
    "centroid_by_label": f"WITH {_CENTROID} SELECT label, pos::INT AS pos, round(m / len, 6) AS c FROM m JOIN n USING (label)",
    "nearest_label": f"""WITH {_CENTROID}, s AS (SELECT vec_id, cent.label AS label, list_inner_product(embedding::DOUBLE[], centroid) AS sim FROM embeddings, cent),
        b AS (SELECT vec_id, label, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s) SELECT vec_id, CASE WHEN sim >= 0.2 THEN label END AS label, round(sim, 6) AS sim FROM b WHERE rn = 1""",
    "representative_member": f"""WITH {_CENTROID}, s AS (SELECT e.label, vec_id, round(list_inner_product(embedding::DOUBLE[], centroid), 6) AS sim FROM embeddings e JOIN cent USING (label))
        SELECT label, vec_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) = 1""",
    "similar_vector_pairs": """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
        SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.38""",
    "similar_vector_classes": """WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.38),
        r AS (SELECT vec_id AS id, vec_id AS met FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.met = p.a)
        SELECT id, min(met) AS class, (SELECT count(*) FROM p WHERE p.a = id) AS links FROM r GROUP BY id""",
    "complete_linkage_groups": """WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
        o AS MATERIALIZED (SELECT a AS node, row_number() OVER (ORDER BY count(*) DESC, a) AS k FROM p GROUP BY a),
        n AS MATERIALIZED (SELECT x.k, coalesce(list(y.k) FILTER (y.k < x.k), []) AS before FROM p JOIN o x ON p.a = x.node JOIN o y ON p.b = y.node GROUP BY x.k),
        r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS g UNION ALL
            SELECT n.k, list_append(g, coalesce(list_filter(list_sort(list_distinct(list_transform(before, lambda u: g[u]))),
                lambda s: len(list_filter(before, lambda u: g[u] = s)) = len(list_filter(g, lambda y: y = s)))[1], n.k)) FROM r JOIN n ON n.k = r.k + 1),
        t AS (SELECT unnest(g) AS s, generate_subscripts(g, 1) AS k FROM (SELECT g FROM r ORDER BY k DESC LIMIT 1)),
        c AS (SELECT s, k FROM t QUALIFY count(*) OVER (PARTITION BY s) > 1)
        SELECT x.node AS seed, y.node FROM c JOIN o x ON c.s = x.k JOIN o y ON c.k = y.k""",
    "online_clustering": """WITH RECURSIVE e AS (SELECT label AS owner, vec_id AS id, embedding::DOUBLE[] AS e, vec_id % 10 <> 9 AS ok FROM embeddings),
        f AS MATERIALIZED (SELECT owner, id, ok, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM e),
        r AS (SELECT DISTINCT owner, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS person, 0.0::DOUBLE AS sim, []::DOUBLE[][] AS cents, []::BIGINT[] AS ns FROM f UNION ALL
            SELECT owner, k, id, CASE WHEN joins THEN p - 1 WHEN ok THEN len(cents) END, coalesce(best, 0.0),
                CASE WHEN joins AND ok THEN list_transform(cents, lambda c, i: CASE WHEN i = p THEN list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-9)) ELSE c END)
                    WHEN ok AND NOT joins THEN list_append(cents, v) ELSE cents END,
                CASE WHEN joins THEN list_transform(ns, lambda n, i: n + (i = p)::BIGINT) WHEN ok THEN list_append(ns, 1) ELSE ns END
            FROM (SELECT *, coalesce(best >= 0.2, false) AS joins, list_transform(list_zip(cents[p], v), lambda z: (z[1] * ns[p] + z[2]) / (ns[p] + 1)) AS m
                FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS p
                    FROM (SELECT f.*, r.cents, r.ns, list_transform(r.cents, lambda c: list_inner_product(c, f.v)) AS sims FROM r JOIN f ON f.owner = r.owner AND f.k = r.k + 1))))
        SELECT owner::BIGINT AS owner, id, person, round(sim, 6) AS sim FROM r WHERE k > 0""",
    "query_kinds": """SELECT conv_id, turn, ['date', 'date', 'place', 'document', 'object', 'document', 'date', 'object', 'object', 'date', 'document', 'place'][(conv_id + turn) % 12 + 1] AS kind FROM conversations""",
    "rrf_fusion": f"WITH {_LANES}, {_fused(1.0, 0.2, 'img')} SELECT vec_id, round(score, 6) AS score, place FROM fused",
    "retrieval_metrics": f"""WITH {_LANES}, {_fused(0.2, 0.5, 'desc')}, rel AS (SELECT vec_id FROM embeddings WHERE label IN (3, 4)),
        t AS (SELECT place, vec_id IN (SELECT vec_id FROM rel) AS hit FROM fused WHERE place <= 10), i AS (SELECT sum(1 / log2(k + 1.0)) AS ideal FROM range(1, 11) r(k))
        SELECT 'q' AS query, round(sum(hit::INT) / 10, 6) AS precision, round(sum(hit::INT) / (SELECT count(*) FROM rel), 6) AS recall,
        round(sum(hit::INT / log2(place + 1.0)) / (SELECT ideal FROM i), 6) AS ndcg FROM t""",
    "fused_rows": f"""WITH {_LANES.replace("img AS (", "i0 AS (").replace("dsc AS (", "d0 AS (")}, rows AS (SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 2, 5)),
        img AS (SELECT vec_id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM i0 WHERE vec_id IN (SELECT vec_id FROM rows)), dsc AS (SELECT vec_id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM d0 WHERE vec_id IN (SELECT vec_id FROM rows)),
        {_fused(1.0, 0.2, "img")} SELECT vec_id, label, round(score, 6) AS score, place FROM fused JOIN rows USING (vec_id)""",
    "keyword_places": f"""WITH {PHOTOS_SQL}, k AS (SELECT id, CASE WHEN tone <> 'P' THEN shoot_time ELSE '' END AS t FROM photos WHERE contains(lower(path), 'nation_1'))
        SELECT id, row_number() OVER (ORDER BY t = '', t DESC, id DESC) - 1 AS place FROM k""",
    "judged_pool": f"WITH {_LANES} SELECT vec_id FROM kw WHERE rank < 20 UNION SELECT vec_id FROM img WHERE rank < 20 UNION SELECT vec_id FROM dsc WHERE rank < 20",
}
