"""Chunks and supporting sentences: cases by hand, and random texts against a plain reading line by line."""

import random
import re

from tickloom.operators import chunks


def plain_chunks(text, most):
    out, stack, held, fenced = [], {}, [], False

    def close():
        rest, part = "\n".join(held).strip(), 0
        held.clear()
        path = " > ".join(stack[k] for k in sorted(stack))
        while rest:
            stops = [i for i in range(int(most * 0.6) + 1, most + 1) if rest[i - 1 : i] in tuple("。！？.!?；;\n")]
            cut = len(rest) if len(rest) <= most else max(stops, default=most)
            part += 1
            out.append((len(out) + 1, part, path, rest[:cut].strip()))
            rest = rest[cut:].strip()

    for line in re.split(r"\r\n|\r|\n", text):
        mark = re.match(r"\s*(```|~~~)", line)
        title = re.match(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if title and not fenced:
            close()
            stack = {k: v for k, v in stack.items() if k < len(title[1])} | {len(title[1]): title[2]}
        elif line.strip() or fenced:
            fenced ^= bool(mark)
            held.append(line)
        else:
            close()
    close()
    return out


def run(spark, texts, most):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for r in chunks.chunks(docs, "doc", most=most).orderBy("doc", "block").collect():
        got.setdefault(r["doc"], []).append(tuple(r)[1:])
    return [got.get(i, []) for i in range(len(texts))]


def test_headings_and_fences(spark):
    text = "top\n# A\none\ntwo\n\n### C ##\nthree\n## B\nfour\n```\n# no heading\n\nstill\n```\n\nfive\n# D\n~~~\nopen\n\n# to the end"
    want = [(1, 1, "", "top"), (2, 1, "A", "one\ntwo"), (3, 1, "A > C", "three"), (4, 1, "A > B", "four\n```\n# no heading\n\nstill\n```"), (5, 1, "A > B", "five"), (6, 1, "D", "~~~\nopen\n\n# to the end")]
    assert run(spark, [text, None, "", " \n\t\n", "# only a heading"], 1800) == [want, [], [], [], []]


def test_long_blocks(spark):
    assert run(spark, ["a" * 25, "a" * 7 + "." + "b" * 9, "a" * 5 + "." + "b" * 9, "a" * 6 + ".  b. " + "c" * 5], 10)[0:2] == [[(1, 1, "", "a" * 10), (2, 2, "", "a" * 10), (3, 3, "", "a" * 5)], [(1, 1, "", "a" * 7 + "."), (2, 2, "", "b" * 9)]]


def test_random_texts_equal_a_plain_reading(spark):
    rng = random.Random(9)
    bits = ["word ", "end. ", "\n", "\n\n", "# h\n", "## two ##\n", "#### deep\n", "```\n", "~~~ x\n", "\r\n", " \t\n", "问题。", "a;b", "   # in\n", "    # far\n", "#no\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert run(spark, texts, 40) == [plain_chunks(t, 40) for t in texts]


def test_supported(spark):
    source = "Rates rose again today. Markets fell after rates rose sharply!\nNothing else happened"
    rows = [(0, "rates rose", source, "rates rose sharply"), (1, "markets fell", source, "no such text"), (2, "bananas ripen slowly", source, "no such text"), (3, None, source, "absent"), (4, "x", None, "absent"), (5, "rates rose", source, "absent")]
    got = {r["n"]: (r["quote"], r["match"]) for r in chunks.supported(spark.createDataFrame(rows, "n int, content string, source string, proposed string")).collect()}
    first, second = "Rates rose again today.", "Markets fell after rates rose sharply!"
    assert got == {0: ("rates rose sharply", "exact"), 1: (second, "sentence"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (first, "sentence")}
