"""Small tables with every awkward case, and plain versions of what the operators do."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, fp string, n string, ids string, size string"


def awkward_texts(seed=3):
    r = random.Random(seed)
    words = ["stone", "River", "lamp", "über", "naïve", "東京", "x" * 70, "paper", "Sky", "don't", "3.14", "<|endoftext|>", "🙂", "tail end"]
    say = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    passage = say(60)
    base = say(120)
    near = base.split(" ")
    near[70] = "changed"
    texts = [None, "", "", " \t\n ", "one", "one two three", base, base, base, " ".join(near), say(2500)]
    texts += [say(30) + " " + passage + " " + say(25), passage + say(3), say(40) + passage, passage * 3, "ab" * 400, "ab" * 150, "é" * 300]
    return texts + [say(r.randrange(1, 200)) for _ in range(25)] + ["퟿ end", "a\r\n\x0b\x0cb", "tab\tstop  two"]


def docs_frame(spark, texts=None, first=1):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, None, "s", None if t is None else len(t), "a", "b", "c", "d", "e") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def with_doubles(df):
    """The same with a repeated row and rows without doc_id."""
    some = df.filter("doc_id in (5, 7)")
    return df.unionByName(df.filter("doc_id = 7")).unionByName(some.withColumn("doc_id", some.doc_id * None))


def groups_of(n, linked):
    """Smallest member of each item's connected component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def repeated_bytes(texts, length=200):
    """For each text: kept bytes, removed, maximal removed runs."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(gone), runs))
    return out
