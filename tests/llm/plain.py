"""Plain versions of the operators, to hold their results against."""

import hashlib
import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_documents(seed=7):
    """(doc_id, text, lang, source) with nulls, empty and long texts, ties, repeated rows, near copies and shared passages."""
    rnd = random.Random(seed)
    w = [f"w{i}" for i in range(300)] + ["the", "of", "and", "Über", "naïve", "数据"]
    say = lambda n: " ".join(rnd.choice(w) for _ in range(n))
    rows = [(i, say(rnd.randint(1, 120)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None])) for i in range(40)]
    base, passage = say(80).split(), say(45)
    for i in range(40, 60):
        near = list(base)
        near[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(near), "en", "a"))
    rows += [(i, f"{say(rnd.randint(0, 30))} {passage} {say(rnd.randint(0, 30))}", "en", "b") for i in range(60, 75)]
    rows += [(75 + i, rows[3][1], "en", "a") for i in range(5)]
    rows += [(90, None, None, None), (91, "", "en", ""), (92, " \n\t ", "en", "a"), (93, say(6000), "de", "c"), (94, "a " * 300, "en", "b"), (95, "word", "en", "b"), (96, "WORD", "en", "b"), (97, "All rights reserved. CC-BY, all rights reserved", "en", "c"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, rows[8][1], "en", "a")]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string"


def documents(spark, rows=None):
    """The odd documents, with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows if rows is not None else odd_documents(), SCHEMA).repartition(3)
    return df.selectExpr("*", "1 AS id", "'x' AS text_hash", "2 AS size", "3 AS n_words", "4 AS shard", "5 AS key", "6 AS epochs", "7 AS cuts")


def classes(rows, k, num, den):
    """(id, size, component) of each row; a row is told by its id and text."""
    sets = {}
    for i, t in rows:
        w = SPACE.findall(low(t))
        sets[i, t] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    nodes = [n for n in sets if n[0] is not None and sets[n]]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(nodes):
        for b in nodes[:n]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i, t]), find((i, t))[0] if (i, t) in root else i) for i, t in rows]


def deduped(rows, n=20):
    texts = [(i, SPACE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[s : s + n])] < (i, s):
                gone.update(range(s, s + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def contaminated(rows, items, span=13):
    held = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        m = min(span, len(w))
        for s in range(len(w) - m + 1) if w else ():
            held.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for i, t in rows:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for m in {len(k) for k in held}:
            for s in range(len(w) - m + 1):
                own = held.get(tuple(w[s : s + m]))
                if own:
                    hit.update(range(s, s + m))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
