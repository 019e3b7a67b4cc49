"""Small documents with every awkward case, and tables with columns whose names clash with inner ones."""

from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
LONG = "lorem ipsum " * 6_000 + "\n" + "x" * 9_000

TEXTS = [
    None,
    "",
    " \n\t\n ",
    "One shared line here\nown line alpha beta gamma delta epsilon zeta",
    "one SHARED line here  \nAnother own line with words in it",
    "\tone shared line here\r\n\nlast",
    "Ärger über Größe\nİstanbul İ K\n日本語 テキスト",
    LONG,
    "a b c d",
    "A B C D",
    "mail jo.x@mail.example.com or +1 (415) 555-1234 at 10.0.0.255, 999.1.1.1, 4111 1111 1111 1111 or 4111 1111 1111 1112",
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("size", "shard", "class", "score", "copies", "hi", "docs", "slot", "mix_c", "n")],
    ]
)


def documents(spark, extra=()):
    """Awkward texts, twelve rows with one line in common, repeated rows and null ids."""
    rows = [(i, t) for i, t in enumerate([*TEXTS, *extra])]
    rows += [(10_000 + i, f"common line\nrow number {i} of twelve has words {i * 7} and more {i * 13} here") for i in range(12)]
    rows += [(3, TEXTS[3]), (3, TEXTS[3]), (None, "one shared line here\nno id"), (None, None)]
    sources = ["b", None, "a", "", "é"]
    full = [(i, t, "en", sources[k % 5], None if k % 3 else len(t or ""), *["c"] * 10) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
