import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, spans string, length int"


def documents(spark, texts, ids=None):
    """Documents with columns whose names also stand in results."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t), "x", 1, "y", 2) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Nulls, blanks, ties, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = [None, "", "  \n\t", "one", "one", "ONE", "two words"]
    for _ in range(n):
        out.append(prose(rng, rng.randrange(20, 200), 5000))
    base = out[10].split()
    for k in range(6):
        edited = list(base)
        edited[k] = "changed"
        out.append(" ".join(edited))
    out += [out[12], out[12].upper(), f"{prose(rng, 30)} {passage}\n{prose(rng, 50)}", f"{passage} {prose(rng, 10)}", "the " * 120, prose(rng, 30_000, 10**6)]
    return out
