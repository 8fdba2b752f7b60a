"""Small tables that hold what operators must not stumble over."""

LONG = " ".join(f"word{i % 977} turns{i % 331}" for i in range(30_000))

TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog near the river"),
    (1, "the quick brown fox jumps over the lazy dog near the river"),
    (2, "The QUICK brown fox jumps over the lazy dog near the river"),
    (3, ""),
    (4, None),
    (5, "   \t\n "),
    (6, "one"),
    (7, "two words"),
    (8, LONG),
    (8, LONG),
    (9, LONG + " end"),
    (None, "a text without an id"),
    (None, None),
    (10, "ünïcödé 😀 ▁ tab\there\nand a line"),
    (11, "\u0000 control \x1f characters \r\n here"),
]


def documents(spark, rows=TEXTS):
    """Documents with columns whose names operators use inside."""
    data = [(i, t, "en", f"src{n % 3}" if n else None, len(t or ""), n, 1.5, "x", True) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, fp int, score double, pieces string, k1 boolean"
    )


def empty(spark):
    return documents(spark).limit(0)


def same(left, right):
    """Equal rows, whatever their order, counted as often as they come."""
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, left)) == sorted(map(key, right))
