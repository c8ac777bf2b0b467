"""Small inputs with the odd rows that every operator must bear."""

import random

WORDS = ["the", "of", "and", "river", "stone", "glass", "north", "paper", "winter", "garden", "copper", "silent", "engine", "harbor", "meadow", "signal", "thread", "violet", "walnut", "yellow"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, blob string, _may boolean, tokens int, posterior string, rate string, count long"


def text(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ed", str(draw.randrange(30))]) for _ in range(n))


def rows(texts: list, first: int = 0) -> list[tuple]:
    return [(first + k, t, "en" if k % 3 else "de", f"s{k % 4}", len(t or ""), 0.5, "x", "y", True, 1, "p", "r", 3) for k, t in enumerate(texts)]


def documents(spark, texts: list, first: int = 0):
    return spark.createDataFrame(rows(texts, first), DOCS)


def odd_texts() -> list:
    return [None, "", "  \n\t ", "one", "two words", "ünï çode 日本 😀", "a" * 5000, "word " * 4000, "same text here for all of us", "same text here for all of us", "it's they're we'll 'quoted' !!! 12 345"]
