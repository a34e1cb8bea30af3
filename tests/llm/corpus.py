"""A small corpus with every awkward row: nulls, blanks, copies, near copies, very long texts, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, component_id string, uid string, size string"


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("aeiou") * rng.randint(1, 3) + rng.choice("klmnop") for _ in range(n)]


def rows(seed=1, n=40):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(3, 120))) for _ in range(n)]
    base = words(rng, 150)
    for k in range(6):  # near copies, ever farther from the first
        changed = list(base)
        for i in range(0, k * 6, 3):
            changed[(i * 7) % 150] = f"x{k}{i}"
        texts.append(" ".join(changed))
    shared = " ".join(words(rng, 60))
    texts += [f"{' '.join(words(rng, 20))} {shared} {' '.join(words(rng, 9))}" for _ in range(3)]
    texts += [texts[0], texts[0], texts[1].upper(), None, None, "", "  \t\n ", "one", "two words", "é ü   漢字 😀", " ".join(words(rng, 30_000)), "a" * 100_000]
    out = [(i, t, "en", [None, "s1", "s0", "s2"][i % 4 if i % 3 else 1], len(t or ""), "r", "c", "u", "z") for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, texts[2], None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
