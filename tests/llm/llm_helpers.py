"""Small document tables with every odd case, and plain Python versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "did string, doc_id long, text string, lang string, source string, n_chars long, rh int, size string, key int, kept int, shard int"


def prose(rng, n, vocabulary=200):
    words = [f"{'aeiou'[k % 5]}{'bcdfgklmn'[k % 9]}{'xyz'[k % 3]}{k}" for k in range(vocabulary)]
    out = []
    for k in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", "!\n", "\n\n"])
    return " ".join(out)


def documents():
    """(doc_id, text, lang, source): nulls, empties, blanks, one very long text, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    rows = []
    for k in range(40):
        text = prose(rng, rng.randint(3, 220))
        if k % 4 == 0:
            text = prose(rng, 20) + " " + passage + " " + prose(rng, 15)
        rows.append([100 + 3 * k, text, ["en", "de", None][k % 3], [f"s{k % 5}", None][k % 7 == 0]])
    texts = [r[1] for r in rows]
    rows += [[500 + k, texts[k % 3], "en", "s0"] for k in range(9)]  # copies
    rows += [[520 + k, texts[5].upper() if k else texts[5].lower(), "en", "s1"] for k in range(2)]
    for k in range(6):  # near copies of a long one
        w = texts[7].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append([540 + k, " ".join(w), "en", "s2"])
    rows += [
        [600, None, "en", "s0"], [601, "", None, "s9"], [602, " \t\n ", "en", None], [603, "a", "en", "s0"],
        [604, "xy " * 300, "en", "s0"], [605, "z" * 900, "en", "s0"], [606, "é ü ß 日本語 🙂 " * 12, "en", "s3"],
        [607, prose(rng, 9000), "en", "s3"], [608, "two words", "en", "s3"], [609, "Two Words", "en", "s3"],
        [None, "null id text with some words in it", "en", "s4"], [-7, "a negative id", "en", "s4"], [10**15, "a far id", "en", "s4"],
    ]
    rows += [list(rows[1])] * 2  # repeated rows
    rng.shuffle(rows)
    return rows


def sort_key(i):
    return -(2**63) if i is None else i
