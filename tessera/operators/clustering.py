"""Helpers whose result depends on an order: a group passes its task as a sorted stream, and only the state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.versions import Versions


def in_sequence(rows: DataFrame, key: str, order: list[Column], fresh: Callable, answered: Callable[[pd.DataFrame, list], pd.DataFrame], schema) -> DataFrame:
    """Rows of equal ``key`` pass, by ``order``, a function that ``fresh`` makes for each key; ``answered`` turns a batch and its answers into rows.

    Spark deals the keys and sorts each partition outside of Python, spilling
    where it must, so a group of any size needs the memory of a batch and of its
    state, and many small groups share a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, at, step = False, None, None
        for pdf in batches:
            answers = []
            for row in pdf.itertuples(index=False):
                own = getattr(row, key)
                if not begun or not (own == at or pd.isna(own) and pd.isna(at)):
                    begun, at, step = True, own, fresh()
                answers.append(step(row))
            yield answered(pdf, answers)

    return rows.repartition(key).sortWithinPartitions(F.col(key), *order).mapInPandas(run, schema)


#: The person of a face that a user took away from all persons.
NOBODY = -1


class Rows:
    """A matrix that grows row by row."""

    def __init__(self) -> None:
        self.held, self.n = np.zeros((0, 0)), 0

    def add(self, row: np.ndarray) -> None:
        if self.n == len(self.held):
            wider = np.zeros((max(16, 2 * self.n), len(row)))
            if self.n:
                wider[: self.n] = self.held
            self.held = wider
        self.held[self.n] = row
        self.n += 1

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _suppressor(limit: float) -> Callable:
    kept = Rows()

    def stays(row) -> bool:
        c = np.array([row.x1, row.y1, row.x2, row.y2], dtype=float)
        area = (c[2] - c[0]) * (c[3] - c[1])
        if kept.n:
            k = kept.all
            sides = np.clip(np.minimum(k[:, 2:4], c[2:]) - np.maximum(k[:, :2], c[:2]), 0, None)
            shared = sides[:, 0] * sides[:, 1]
            union = k[:, 4] + area - shared
            if (shared > limit * np.where(union > 0, union, np.inf)).any():
                return False
        kept.add(np.append(c, area))
        return True

    return stays


def non_maximum_suppression(boxes: DataFrame, limit: float = 0.45) -> DataFrame:
    """Boxes of each image that no better box that stays overlaps by more than ``limit`` of the union; equal scores by id.

    A task holds the boxes of one image that stay and one batch of rows.
    """
    order = [F.desc("score"), F.asc("id")]
    return in_sequence(boxes, "image", order, lambda: _suppressor(limit), lambda pdf, stays: pdf[np.array(stays, dtype=bool)], boxes.schema)


class Registrar:
    """The persons of one owner: number, centroid and count of each."""

    def __init__(self, least: float) -> None:
        self.least, self.centroids = least, Rows()
        self.numbers: list[int] = []
        self.counts: list[int] = []

    def know(self, number: int, centroid: np.ndarray, count: int) -> None:
        self.centroids.add(centroid)
        self.numbers.append(number)
        self.counts.append(count)

    def _meet(self, at: int, v: np.ndarray, moves: bool) -> None:
        if moves:
            mean = (self.centroids.all[at] * self.counts[at] + v) / (self.counts[at] + 1)
            self.centroids.all[at] = mean / (np.linalg.norm(mean) + 1e-9)
        self.counts[at] += 1

    def person_of(self, row, given: int | None = None) -> tuple[int | None, float]:
        """The person that a face joins or founds, and how similar it is; ``given`` says who it is, or that it is nobody."""
        v = np.asarray(row.embedding, dtype=float)
        v = v / (np.linalg.norm(v) or 1.0)
        if given == NOBODY:
            return None, 0.0
        if given is not None and given in self.numbers:
            self._meet(self.numbers.index(given), v, row.verdict == "ok")
            return given, 1.0
        sims = self.centroids.all @ v if self.numbers else np.zeros(0)
        at = int(sims.argmax()) if len(sims) else None
        sim = float(sims[at]) if len(sims) else 0.0
        if at is not None and sim >= self.least:
            self._meet(at, v, row.verdict == "ok")
            return self.numbers[at], sim
        if row.verdict != "ok":  # a marginal face may join a person but not found one
            return None, sim
        self.know(max(self.numbers, default=-1) + 1, v, 1)
        return self.numbers[-1], sim


def _registered(pdf: pd.DataFrame, answers: list[tuple[int | None, float]]) -> pd.DataFrame:
    persons, sims = pd.array([p for p, _ in answers], dtype="Int64"), np.array([s for _, s in answers], dtype=float)
    return pd.DataFrame({"owner": pdf["owner"], "id": pdf["id"], "person": persons, "sim": sims})


def register_faces(faces: DataFrame, least: float = 0.55) -> DataFrame:
    """(owner, id, person, sim): faces of an owner join, in order of id, the person of nearest centroid or found a new one.

    The result depends on the order by definition, so an owner's faces are one
    sequence; owners are independent and run in parallel. A task holds the
    centroids of an owner's persons and one batch of faces, never all faces.
    """
    rows = faces.select("owner", "id", "embedding", "verdict")
    return in_sequence(rows, "owner", [F.asc("id")], lambda: Registrar(least).person_of, _registered, "owner long, id long, person long, sim double")


#: In the sequence of an owner: known persons, then faces, then the end.
PERSON, FACE, END = 0, 1, 2
RESUMED = "owner long, id long, person long, sim double, faces long, centroid array<double>"


def _resuming(least: float) -> Callable:
    persons = Registrar(least)

    def step(row) -> list[tuple]:
        if row.kind == PERSON:
            persons.know(int(row.id), np.asarray(row.embedding, dtype=float), int(row.faces))
            return []
        if row.kind == FACE:
            return [(row.id, *persons.person_of(row, None if pd.isna(row.given) else int(row.given)), None, None)]
        return [(None, number, None, count, centroid.tolist()) for number, count, centroid in zip(persons.numbers, persons.counts, persons.centroids.all, strict=True)]

    return step


def _resumed(pdf: pd.DataFrame, answers: list[list[tuple]]) -> pd.DataFrame:
    flat = [(owner, *answer) for owner, own in zip(pdf["owner"], answers, strict=True) for answer in own]
    out = pd.DataFrame(flat, columns=["owner", "id", "person", "sim", "faces", "centroid"], dtype=object)
    return out.astype({"owner": "Int64", "id": "Int64", "person": "Int64", "faces": "Int64", "sim": "Float64"})


class FaceRegistry:
    """The persons of all owners, kept in versions; each batch of faces goes on from the latest.

    A version is one table of both the persons and the answers for the batch that made it, published as a whole: a batch
    that dies leaves the registry as it was and can be done again. Only owners with new faces pass a task; the others'
    persons are copied.
    """

    def __init__(self, spark: SparkSession, path: str, least: float = 0.55) -> None:
        self.spark, self.least = spark, least
        self.versions = Versions(spark, path)

    def persons(self) -> DataFrame:
        """(owner, person, faces, centroid) as they stand."""
        now = self.versions.read()
        rows = self.spark.createDataFrame([], RESUMED) if now is None else now
        return rows.where("faces is not null").select("owner", "person", "faces", "centroid")

    def register(self, faces: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
        """(owner, id, person, sim) of ``faces`` (owner, id, embedding, verdict), in order of id within an owner.

        ``overrides`` (owner, id, person) say who a face is, before any comparison: NOBODY, or a person, if it exists by then.
        Faces without an owner, id or embedding are left out.
        """
        persons = self.persons()
        rows = faces.where("owner is not null and id is not null and embedding is not null")
        named = rows.withColumn("given", F.lit(None).cast("long"))
        if overrides is not None:
            given = overrides.groupBy("owner", "id").agg(F.max("person").cast("long").alias("given"))
            named = rows.join(given, ["owner", "id"], "left")
        none = F.lit(None)
        owners = rows.select("owner").distinct()
        sequence = named.select("owner", F.lit(FACE).alias("kind"), "id", F.col("embedding").cast("array<double>").alias("embedding"), "verdict", none.cast("long").alias("faces"), "given")
        sequence = sequence.union(persons.join(owners, "owner", "left_semi").select("owner", F.lit(PERSON), "person", "centroid", none, "faces", none))
        sequence = sequence.union(owners.select("owner", F.lit(END), none, none, none, none, none))
        settled = in_sequence(sequence, "owner", [F.asc("kind"), F.asc("id")], partial(_resuming, self.least), _resumed, RESUMED)
        others = persons.join(owners, "owner", "left_anti").select("owner", none.cast("long"), "person", none.cast("double"), "faces", "centroid")
        number = self.versions.publish(settled.union(others))
        return self.versions.read(number).where("id is not null").select("owner", "id", "person", "sim")
