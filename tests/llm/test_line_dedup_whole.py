"""Line dedup against a brute force that only knows 'a run of 50 words or more that stands earlier'."""

import collections
import random
import re

from loomspan.llm import line_dedup

DOCS = "doc_id long, text string"


def standing_earlier(docs, min_words=50):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen, gone = set(), collections.defaultdict(set)
    for i, t in sorted(docs):
        lines = [x for x in ((s, len(word.findall(s)), n) for n, s in enumerate(t.split("\n"))) if x[1]]
        for a in range(len(lines)):
            here = []
            for b in range(a + 1, len(lines) + 1):
                if sum(x[1] for x in lines[a:b]) >= min_words:
                    run = tuple(x[0] for x in lines[a:b])
                    if run in seen:
                        gone[i] |= set(range(lines[a][2], lines[b - 1][2] + 1))
                    here.append(run)
            seen.update(here)
    return gone


def agrees(spark, docs):
    gone = standing_earlier(docs)
    want = {i: "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in docs}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == want
    return gone


def test_repeat_behind_a_shorter_earlier_piece(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    x, y = line("x", 30), line("y", 22)
    docs = [(1, f"{x}\n{line('a', 60)}"), *((i, "\n".join([line(f"p{i}w", 40), x, y, line(f"q{i}w", 40)])) for i in (2, 3, 4))]
    assert agrees(spark, docs) == {3: {1, 2}, 4: {1, 2}}


def test_random_lines(spark):
    rng = random.Random(11)
    docs = []
    for sizes in ([1, 3, 8, 30, 70], [1, 3, 8, 12], [10], [60, 70, 5], [26, 30, 49]):
        lines = [" ".join(f"v{rng.randrange(9**6)}" for _ in range(rng.choice(sizes))) for _ in range(6)]
        docs += [(len(docs) + k, "\n".join(rng.choice([*lines, ""]) for _ in range(rng.randint(1, 16)))) for k in range(60)]
    assert agrees(spark, docs)


def test_null_ids(spark):
    line = lambda name: " ".join(f"{name}{k}" for k in range(60))
    docs = [(None, f"{line('x')}\n{line('a')}"), (None, f"{line('x')}\n{line('b')}"), (None, f"{line('y')}\n{line('c')}\n{line('y')}"), (1, line("x") + "\nend")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()]
    left = "\n".join(t for _, t in got).split("\n")
    assert len(got) == 4 and (1, "end") in got
    assert left.count(line("x")) == left.count(line("y")) == 1 and (None, f"{line('y')}\n{line('c')}") in got
    assert {line(n) for n in "abc"} <= set(left)
