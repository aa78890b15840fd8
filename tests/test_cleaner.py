import random
import re

import pytest
from pyspark.sql import functions as F

from inkstream.functions.rules import Rules
from inkstream.operators import cleaner

R = Rules()
CUT, DOSE = "The application was granted priority review.", "Take 120 mg orally twice daily."


def reference(text):
    """The rules, said once more as a plain loop."""
    lines = [x.strip() for x in (text or "").split("\n")]
    has = lambda p, x: re.search(p, x, re.I) is not None
    near = lambda i: range(i + 1, min(i + 1 + R.horizon, len(lines)))
    dose = [has(R.dosage_re, x) for x in lines]
    out = []
    for i, x in enumerate(lines):
        colon = bool(out) and out[-1].endswith(":")
        if not x:
            if colon:
                out.append("")
            continue
        if has(R.cutoff_re, x) and not colon and not any(dose[j] or (lines[j].endswith(":") and any(dose[k] for k in near(j))) for j in near(i)):
            break
        if not has(R.boilerplate_re, x) and x not in R.headers:
            out.append(x)
    return re.sub("\n{3,}", "\n\n", re.sub(" +", " ", "\n".join(out).translate(str.maketrans("–—−‘’“”", "---''\"\"")))).strip()


def both(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    a = {r.k: r.c for r in df.select("k", cleaner.clean(F.col("text")).alias("c")).collect()}
    b = {r.k: r.corpus for r in cleaner.clean_by_window(df, "k").collect()}
    return [a[i] for i in range(len(texts))], [b[i] for i in range(len(texts))]


def test_forms_agree(spark):
    rng = random.Random(1)
    pieces = [CUT, DOSE, "By weight:", "", "x", "filler", "Recommended Dosage", "Follow us on X", "recommended dosage", "granted in 2020 g priority review", "a – b  “c”"]
    texts = ["\n".join(rng.choices(pieces, weights=[2, 1, 2, 2, 3, 9, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(300)] + ["", None]
    want = [reference(t) for t in texts]
    a, b = both(spark, texts)
    assert a == want and b == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("\n".join([CUT, *["f"] * 14, DOSE]), "\n".join([CUT, *["f"] * 14, DOSE])),
        ("\n".join(["a", CUT, *["f"] * 15, DOSE]), "a"),
        ("\n".join([CUT, *["f"] * 14, "x:", *["f"] * 14, DOSE]), None),
        ("\n".join(["a", CUT, *["f"] * 14, "x:", *["f"] * 15, DOSE]), "a"),
        ("A:\n\n\nB", "A:\n\nB"), ("A\n\nB", "A\nB"), ("A:\n" + CUT, "A:\n" + CUT), ("A:\n\n" + CUT, "A:"),
    ],
)
def test_horizon_and_blanks(spark, text, want):
    a, b = both(spark, [text])
    assert a == b == [text if want is None else want]


def test_rescued_lines_can_go(spark):
    df = spark.createDataFrame([(f"A:\n{CUT}\nB",)], "t string")
    assert df.select(cleaner.clean(F.col("t"), drop_rescued=True)).first()[0] == "A:\nB"


def test_work_is_linear_in_lines(spark):
    import time

    took = []
    for n in (2_000, 10_000, 40_000):
        df = spark.createDataFrame([("\n".join("line number %d of text" % k if k % 9 else "Ends with colon:" for k in range(n)),)], "t string")
        began = time.time()
        assert len(df.select(cleaner.clean(F.col("t"))).first()[0].split("\n")) == n
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 2
