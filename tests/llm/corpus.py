"""A small corpus with the cases every operator has to stand: copies, near copies, NULLs, empty, tiny and long
texts, repeated rows, repeated and missing ids, and columns whose names clash with outputs."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "er", "th", "on", "é", "ing", "St", "qu", "ou", "ß"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".\n"]) for w in words)


def records() -> list[tuple]:
    base = [prose(i, 40 + 7 * i) for i in range(12)]
    shared = prose(99, 60)
    edited = base[3].split(" ")
    edited[5] = "changed"
    texts = [
        *base,
        base[0], base[0],  # copies
        " ".join(edited),  # a near copy
        prose(50, 30) + "\n" + shared + "\n" + prose(51, 30), shared, prose(52, 10) + "\n" + shared,
        None, "", " \n\t ", "one", "One two", "one two",
        "word " * 3000, prose(60, 20_000),
        "日本語のテキスト 😀 mixed\u0000control space",
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, base[4], None, None, None), (None, None, None, None, None), (7, "a different text with the same id", "en", "s", 1)]
