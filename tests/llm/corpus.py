"""Small corpora with the cases that matter: nulls, blanks, copies, near copies, ties, long texts."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _q_id string, _l_id int"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("pha", "ta", "mma", "lta", "silon", "nd", "x", "é")]
    line = lambda k: " ".join(rng.choices(words, k=k)).capitalize() + "."
    shared = [line(30), line(25), line(9)]
    texts = []
    for i in range(n):
        parts = [line(rng.randint(5, 25)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[i % 3])
        if i % 7 == 0:
            parts += parts[:3]
        texts.append("\n".join(parts))
    texts += [texts[3], texts[3], texts[5] + " tail", texts[5].replace(" ", "  ", 1), texts[8].upper()]
    near = texts[10].split(" ")
    for i in range(6):
        own = list(near)
        own[(7 * i) % len(own)] = f"changed{i}"
        texts.append(" ".join(own))
    texts += ["", " \t\n ", None, "one", "one two three", "one two three", "\n\n\nA\n\nB\nC\n", "a " * 3000, line(4000), "\x0b\x0cx\x1cy\xa0z"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t or ""), "x", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, "a null key with more than enough words in it for a window of any kind", None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
