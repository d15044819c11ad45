"""Rows and helpers that the tests of this folder share."""

import random
import re

SF = "/root/testdata/sf0.001"
SPACE = "[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that the operators use themselves
          "size long, u double, score double, row string, kept string, id long, hash long, "
          "text_hash long, label int, set_no long, target double, tokens string, copies long")


def words_of(text):
    return re.findall(SPACE, text or "")


def odd_rows():
    """Nulls in every column, empty, long, equal and nearly equal texts, repeated rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijé中", k=rng.randint(1, 8)))
    prose = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " ", "\n\t", "one", "one", "a b c d", "A B C D", *prose, prose[0], prose[0],
             prose[1] + " extra", prose[2].upper(), passage + " " + prose[3], prose[4] + "\n" + passage,
             " ".join(word() for _ in range(6000)), "x" * 5000, "###" * 40, "<|endoftext|> a <|startoftext|>",
             "tail space  \n\n", "line\nline\nline\n", "é" * 300]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if i != 7 else None, t, ["en", None, "de"][i % 3],
                     [None, "a", "b", "B", "é"][i % 5], None, *([None] * 13)))
    return [*rows, rows[9], rows[9], rows[0], rows[4]]
