"""Small tables with every awkward case, and plain-Python forms of what the operators compute."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, size long, key string, component string"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n=40):
    import random

    r = random.Random(seed)
    return " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt".split()) + str(r.randrange(50)) for _ in range(n))


def texts():
    base = prose(1)
    words = base.split()
    edited = " ".join(words[:20] + ["inserted"] + words[21:])
    return [
        base, base, base.upper(), base.replace(" ", "\n"), edited, prose(2), prose(2) + "\n" + prose(3), prose(3), "", None, " \t\r\n", "x", "a b", "a  B",
        "été ÉTÉ été naïve", "ſecret K token", "word " * 6000, "z" * 50_000, "\n".join([prose(4, 8)] * 3 + ["tail"]), "\n\n\n",
    ]


def documents(spark, values=None, ids=None):
    """Rows in the shape of ``documents`` with extra columns whose names the operators use inside."""
    values = texts() if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    rows = [
        (i, t, "en" if n % 3 else None, [None, "b", "a", "é", ""][n % 5], len(t) if t else None, "d", 7, 9, "k", "c")
        for n, (i, t) in enumerate(zip(ids, values))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Every text once, some rows twice, and rows without id."""
    values, ids = texts(), list(range(len(texts())))
    values += [values[0], values[5], prose(9), None]
    ids += [0, 5, None, None]
    return documents(spark, values, ids)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def shingle_set(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(values, ids, similar=75):
    """doc_id -> (set size, smallest id reachable), by all pairs."""
    sets = {i: shingle_set(t) for i, t in zip(ids, values)}
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= similar * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}
