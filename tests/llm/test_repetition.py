"""Repetition outliers in clean sources."""

import random

from inkspark.llm import rules


def test_repeated_lines_and_words_are_rejected(spark):
    rng = random.Random(5)

    def line(n=8):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))

    rows = [(i, "\n".join(line() for _ in range(20)), "en", "s") for i in range(300)]
    same, phrase = line(), line()
    rows.append((1000, "\n".join([line() for _ in range(11)] + [same] * 9), "en", "s"))  # 8 of 20 lines repeat
    rows.append((1001, " ".join([line(60)] + [x for _ in range(5) for x in (phrase, line(2))]), "en", "s"))  # 40 of 110 words repeat
    rows.append((1002, "\n".join([line() for _ in range(19)] + [rows[0][1].split("\n")[0]]), "en", "s"))  # repeats nothing of its own
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), carry=["doc_id"]).collect()}
    assert not any(r.base_failed for r in out.values())
    assert not out[1000].kept and not out[1001].kept
    assert out[1002].kept and all(out[i].kept for i in range(300))
