"""Awkward inputs that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = "fp string, kept string, component_id string, size string, h string, score string, cell string, node string, label string, source_size string, __votes string"


def awkward_docs(spark, clashing: bool = True):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, odd characters, clashing names."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
    texts = [
        None, "", " \t\n", "one", "two words", "Hello, it's a TEST of the thing.", "Hello, it's a TEST of the thing.", long, "x" * 50_000, "日本語 テキスト です", "école d'été ça va très bien",
        "\x00 nul \x1c sep \x85 nel \xa0 nbsp", "👩‍👩‍👧 🙂", "<|endoftext|> and <|startoftext|>", "a  b   c\n\n\nd\r\ne", "% $ # * & | < >" * 20, "the cat sat on the mat and " * 40,
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        for c in CLASHING.split(", "):
            name = c.split()[0]
            df = df.selectExpr("*", f"'clash' as {name}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
