"""A small table of odd documents, and plain versions of what words and shingles are."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, node int, _size int, score string, n_lines int, k int, t int, places int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def odd_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé한🙂", k=rng.randint(1, 7))) for _ in range(60)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = make(120)
    some = base.split()
    passage = make(60)
    lines = "\n".join(make(4) for _ in range(9))
    near = [" ".join(some[:i] + ["zzz"] + some[i + 1 :]) for i in (3, 50, 119)]
    out = [None, "", " \t\n ", "a", "a", "A b C", "one two three four", "one two three four five", base, base, base.upper().replace("É", "é"), *near]
    out += [make(20) + " " + passage + " " + make(15), passage + "\n" + make(30), make(40) + " " + passage, passage, passage]
    out += [lines, lines + "\n" + make(5), make(3) + "\n" + lines, "x\n\n\n\n\n\ny", "\n\n\n\n", "same\nsame\nsame\nsame\nsame", make(5000), ("long word" * 3000), "  \u0085 wide", "a\rb\x0bc\x0cd"]
    out += [make(rng.randint(1, 90)) for _ in range(20)]
    return out


def odd_documents(spark, extra=True):
    rng = random.Random(9)
    rows = []
    for i, text in enumerate(odd_texts()):
        lang = rng.choice(["en", "fr", None])
        rows.append((i * 3, text, lang, rng.choice(["s1", "s2", "S3", "é", None]), None if text is None or i % 7 == 0 else len(text)))
    rows.append((-5, "negative id here", "en", None, 16))
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, 5, 6, 7) for r in rows], SCHEMA)
    return frame if extra else frame.select("doc_id", "text", "lang", "source", "n_chars")


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def with_null_id(spark):
    """The odd documents with a repeated row and a null id."""
    docs = odd_documents(spark)
    return docs.union(docs.filter("doc_id = 24")).union(docs.filter("doc_id = 27").selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
