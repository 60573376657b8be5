"""Small frames with the awkward rows that every operator must take."""

import random

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
WORDS = "the of river stone walking amber quietly north engine paper summer green violin harbour".split()


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randrange(50)) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)).capitalize()


def awkward_texts() -> list[str | None]:
    return [None, "", " \n\t", "one", "two words", "é ß Œ 中文 字", "a\x1cb\x85c\xa0d  x", "<|endoftext|> x<|endoftext|>",
            "it's  'sup\t\tx ½ 12's", "ΟΔΟΣ Σας İstanbul é", "x" * 5000, LONG]


def documents(spark, texts, start=0, **more):
    """doc_id, text, lang, source, n_chars, and columns whose names operators might use inside."""
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or ""), 7, "k", 1, "h")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, `_n` int, key string, "
              "number int, `hash` string")


def awkward(spark):
    """Awkward texts, repeated rows, ties and a row without an id."""
    texts = awkward_texts()
    df = documents(spark, texts + [prose(1), prose(1), prose(2)])
    again = df.where("doc_id in (3, 12)")
    return df.union(again).union(documents(spark, [prose(3)]).selectExpr(
        "cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source",
        "cast(null as long) n_chars", "_n", "key", "number", "`hash`"))


def empty(spark):
    return documents(spark, ["x"]).limit(0)
