import random

import pytest

# Names that operators use inside; documents may have columns of the same names.
CLASHING = "size long, target double, copies long, score double, version long, root long, lines string, segments string, `at` long, cid long, fold int"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=True):
        """``documents`` rows (id, text[, source]) with extra columns whose names clash."""
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHING if clash else "")
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None)
                + ((None, 1.0, 2, 0.5, 3, 4, "x", "y", 5, 6, 7) if clash else ()) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose: ``prose(seed, n_words)``."""
    def make(seed, n):
        rnd = random.Random(seed)
        words = ["".join(rnd.choice(["an", "er", "in", "th", "on", "re", "st", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
        return " ".join(words)

    return make
