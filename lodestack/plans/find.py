"""find: three lanes side by side (tags, full text, nearest passages), without mixing their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LodestackError
from ..functions.text import excerpt
from ..operators.fulltext import find_text
from ..operators.knn import knn, search, with_texts
from ..operators.registry import find_tagged
from ..sources.embedding import Embedder, checked
from .store import Store


@dataclass(frozen=True)
class Report:
    hits: DataFrame  # lane, place, key, title, detail, score
    skipped: str | None  # why the lane of passages didn't run


def lanes(tagged: DataFrame, text: DataFrame, near: DataFrame | None) -> DataFrame:
    """One table of the lanes: tags with weights, texts with ranks (lower is better), passages with distances."""
    rows = tagged.select(F.lit("tagged").alias("lane"), F.col("slug").alias("key"), "title", F.col("kind").alias("detail"), F.col("weight").alias("score"))
    rows = rows.union(text.select(F.lit("text"), "slug", "title", "snippet", "rank"))
    if near is not None:
        rows = rows.union(near.select(F.lit("semantic"), "path", F.lit(None).cast("string"), excerpt(F.col("text")), "distance"))
    return rows


def find(store: Store, phrase: str, embedder: Embedder | None, k: int = 20) -> Report:
    """All lanes; that of passages is skipped, with the reason, if there is no index or the embedder fails."""
    registry = store.registry.snapshot()  # one version for all lanes
    read = registry.read
    tagged = find_tagged(read("creative_works"), read("work_subjects"), phrase)
    text = find_text(store.texts(registry), read("creative_works"), phrase)
    near, skipped = None, None
    try:
        identity = store.current()
        index = store.verify(identity).snapshot()
        if embedder is None:
            skipped = "no embedder"
        else:
            vector = checked(embedder, [phrase], identity.dims)[0]
            near = with_texts(knn(index.read("vec_chunks"), vector, k), index.read("chunks"), index.read("documents"))
    except LodestackError as e:
        skipped = str(e)
    return Report(lanes(tagged, text, near), skipped)


def search_index(store: Store, query: str, embedder: Embedder, limit: int = 10, threshold: float = 0.0) -> DataFrame:
    """(path, text, distance, score) of the current index's nearest passages by cosine."""
    identity = store.current()
    index = store.verify(identity).snapshot()
    vector = checked(embedder, [query], identity.dims)[0]
    near = search(index.read("vec_chunks"), vector, limit, threshold)
    return with_texts(near, index.read("chunks"), index.read("documents")).withColumn("score", 1 - F.col("distance"))
