"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score string, words string, node int, line string, h int, hash int, at int, copy int"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs far away into the dark green forest"


def awkward(spark, rows: list[tuple] | None = None):
    texts = [
        (1, None),
        (2, ""),
        (3, " \n\t  \n"),
        (4, "!!! ??? ---"),
        (5, LONG),
        (6, PROSE),
        (6, PROSE),  # a repeated row
        (None, PROSE + " indeed"),
        (7, "été ÉTÉ 漢字 😀 <|endoftext|> it's"),
        (8, "one"),
        (9, PROSE),  # a tie in every respect but the id
    ]
    texts = texts if rows is None else rows
    return spark.createDataFrame([(i, t, None if i is None else "en", "s", len(t or ""), 0, "k", "s", "w", 0, "l", 0, 0, 0, 0) for i, t in texts], SCHEMA)


# Vectors: the first three are whole, the others are null or hold null or non-finite entries.
VECTORS = [(0, [1.0, 0.5]), (1, [-1.0, 2.0]), (2, [0.25, -3.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, float("inf")])]


def write_tables(spark, folder: str, docs, benchmark=(), labels=(), vectors=()) -> str:
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
