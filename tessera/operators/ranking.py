"""Vector lanes and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, literal
from tessera.operators.numbering import numbered
from tessera.operators.order_statistics import median_and_peak
from tessera.sources.shared import stage

RRF_K = 60
# Words that tell the kind of a query.
DATE_WORDS = ["春天", "夏天", "秋天", "冬天", "今天", "昨天", "今年", "去年", "前天"]
PLACE_WORDS = ["省", "市", "区", "县", "镇", "村", "路", "街", "大道", "景区", "公园", "广场", "广州", "旅游"]
DOCUMENT_WORDS = ["文档", "文件", "截图", "发票", "合同", "证件", "票据", "扫描", "paper", "document"]


def query_kind(query: Column) -> Column:
    """date, place, document or object."""
    q = F.lower(F.trim(query))

    def any_of(words: list[str]) -> Column:
        return q.rlike("|".join(words))

    dated = (q.contains("年") | q.contains("月")) & q.rlike("[0-9]")
    return F.when(dated | any_of(DATE_WORDS), "date").when(any_of(PLACE_WORDS), "place").when(any_of(DOCUMENT_WORDS), "document").otherwise("object")


def lane_weights(kind: str) -> dict[str, float]:
    """Weights of the keyword, image and description lanes."""
    return {"kw": 1.0, "img": 1.0, "desc": 0.2} if kind == "object" else {"kw": 1.0, "img": 0.2, "desc": 0.5}


def comparable(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Vectors of the dimension of the query; others, and null ones, have no score."""
    return vectors.where(F.size("embedding") == len(query))


def rank_absolute(vectors: DataFrame, query: list[float], limit: int, least: float, key: str = "vec_id") -> DataFrame:
    """(key, score) of the ``limit`` vectors of greatest dot product of at least ``least``; ties by key."""
    scored = comparable(vectors, query).select(key, dot(F.col("embedding"), literal(query)).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(limit)


def rank_relative(
    vectors: DataFrame, query: list[float], limit: int, floor: float, per_group: int = 0, min_lift: float = 0.0, key: str = "vec_id", group: str | None = None
) -> DataFrame:
    """(key, rel) of the best vectors by dot product above the median of all.

    The lane is empty if its peak lies less than ``min_lift`` above the median. Scores are written once, so that neither
    the passes of the median nor the ranking read vectors again.
    With ``per_group`` at most so many rows of a group stay, the best of it.
    """
    columns = [key] + ([group] if group else [])
    scored = stage(comparable(vectors, query).select(*columns, dot(F.col("embedding"), literal(query)).alias("score")), "scores")
    middle, peak = median_and_peak(scored, "score")
    rel = scored.select(*columns, (F.col("score") - middle).alias("rel")).where(F.col("rel") >= floor)
    if peak is None or not peak - middle >= min_lift:
        rel = rel.where(F.lit(False))
    if per_group and group:
        # a filter on a row number keeps per_group rows of a group in each task before the exchange
        own = Window.partitionBy(group).orderBy(F.desc("rel"), key)
        rel = rel.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_group)
    return rel.orderBy(F.desc("rel"), key).limit(limit).select(key, "rel")


def fuse(lanes: dict[str, DataFrame], kind: str, key: str) -> DataFrame:
    """(key, score, place) by weighted reciprocal ranks of lanes with columns (key, rank from 0).

    Ties go by rank in the keyword lane, then by a hit in the lane that suits
    the kind of query, then by key.
    """
    weights = lane_weights(kind)
    primary = "img" if kind == "object" else "desc"
    parts = [
        lane.select(F.col(key), F.lit(name).alias("lane"), F.col("rank"), (F.lit(weights[name]) / (RRF_K + F.col("rank") + 1)).alias("part"))
        for name, lane in lanes.items()
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy(key).agg(
        F.sum("part").alias("score"),
        F.min(F.when(F.col("lane") == "kw", F.col("rank"))).alias("kw_rank"),
        F.max(F.when(F.col("lane") == primary, 1).otherwise(0)).alias("primary_hit"),
    )
    place = Window.orderBy(F.desc("score"), F.col("kw_rank").asc_nulls_last(), F.desc("primary_hit"), key)
    return fused.withColumn("place", F.row_number().over(place))


def fuse_and_hydrate(lanes: dict[str, DataFrame], rows: DataFrame, kind: str, key: str) -> DataFrame:
    """The columns of ``rows`` with score and place, by :func:`fuse`.

    The keyword lane comes from rows itself. Hits of the other lanes that rows does not have are dropped first, and those
    behind them move up. Lanes are limited lists; they are matched with rows once, all together.
    """
    vector_lanes = {name: lane for name, lane in lanes.items() if name != "kw"}
    wanted = reduce(DataFrame.unionByName, (lane.select(key) for lane in lanes.values())).distinct()
    met = stage(rows.join(F.broadcast(wanted), key, "left_semi"), "hits")  # as few as the lanes are long
    place = Window.orderBy("rank")
    kept = {name: lane.join(met.select(key), key, "left_semi").select(key, (F.row_number().over(place) - 1).alias("rank")) for name, lane in vector_lanes.items()}
    fused = fuse({**lanes, **kept}, kind, key).select(key, "score", "place")
    return met.join(fused, key).select(*rows.columns, "score", "place")


def keyword_lane(rows: DataFrame, text: str, keyword: str, time: str, key: str) -> DataFrame:
    """``rows`` whose text holds the keyword in any case, with place: latest first, those without a time last, then by key downwards."""
    found = rows.where(F.contains(F.lower(text), F.lit(keyword.lower())))
    dated = found.withColumn("no_time", F.coalesce(F.col(time) == "", F.lit(True)))
    return numbered(dated, [], ["no_time", F.desc(time), F.desc(key)], "place").select(*rows.columns, "place")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """Precision, recall and nDCG at ``k`` of (query, key, place from 1) against (query, key)."""
    top = ranked.where(F.col("place") <= k).join(relevant.select("query", key).distinct().withColumn("hit", F.lit(1)), ["query", key], "left")
    gains = top.groupBy("query").agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(F.coalesce(F.col("hit"), F.lit(0)) / F.log2(F.col("place") + 1.0)).alias("dcg")
    )
    wanted = relevant.groupBy("query").agg(F.countDistinct(key).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return wanted.join(gains, "query", "left").select(
        "query",
        (F.coalesce("hits", F.lit(0)) / k).alias("precision"),
        (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )
