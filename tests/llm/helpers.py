"""Rows that every operator must bear."""

from __future__ import annotations

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, size string, of long, rank int, count long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, and
    extra columns whose names operators might use themselves."""
    long = " ".join(f"{w}{i}" for i in range(4000) for w in WORDS[:5])
    plain = " ".join(WORDS)
    texts = [plain, plain, plain + " end", "", None, "   \n ", long, long + " more", "one", "one", "x" * 200_000, " " * 60_000 + "z", "ünïcödé 😀 text", "a@b.co +1 234 567 8901", "a@b.co +1 234 567 8901"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "k", 1, "s", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[3]]
    rows += [(None, plain, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (99, None, None, None, None, None, None, None, None, None, None)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
