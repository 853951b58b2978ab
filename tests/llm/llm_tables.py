"""Tables and texts that the tests of the training-data operators share."""

import os
import random

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = "start long, n long, token long, score double, ids binary, part int, cls long, key long, size long, taken long"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat."""
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(50_000)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    long = words(1, 20_000, 5_000)
    base = words(2, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, "b"), (5, "", None),
        (6, "one", "c"), (7, long, "a"), (None, words(3, 80), "c"), (8, words(4, 300), None), (9, " \n\t ", "b"),
        (10, "Same Line\n" * 30, "c"), (11, "ÉTÉ é — “x”   y ́", "a"), (12, words(5, 60).upper(), "d"),
    ]
    return [(i, t, "xx", s, len(t or "")) for i, t, s in texts]
