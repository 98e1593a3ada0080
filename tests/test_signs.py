import random
import re
from functools import reduce

from pyspark.sql import functions as F

from eventloom.functions import dates, rules, titles
from eventloom.functions.scalars import SPELLINGS, has_any, replaced_all, signs

TABLES = [titles.TITLE_STEPS, titles.TITLE_STEPS_AFTER, dates.TIME_BEFORE, dates.TIME_AFTER, SPELLINGS, [(p, rules.MASK) for p in rules.CANCEL_MASKS + rules.CLOSED_MASKS]]


def samples(n: int) -> list[str]:
    """Texts of the patterns' own words and marks, which many of the patterns match."""
    rng = random.Random(3)
    sources = [p for t in TABLES for p, _ in t] + [p for p, _ in titles.JUNK] + [a[0] for a in titles.ANNOUNCEMENTS]
    words = sorted({w for p in sources for w in re.findall(r"[^\\()\[\]|?*+{}^$:]+", p)} | {" ", "（", "）", "【", "】", "「", "」", "10時", "令和7年度", "🎵", "航空祭", "1"})
    return ["".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_passing_over_groups_changes_nothing(spark):
    texts = [*samples(6_000), "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = lambda steps: reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, t)
    any_ = reduce(lambda a, b: a | b, [t.rlike(p) & ~t.rlike(u) if u else t.rlike(p) for p, u in titles.JUNK])
    pairs = [(replaced_all(t, x), plain(x)) for x in TABLES] + [(has_any(t, titles.JUNK), any_)]
    wrong = df.select(*[F.count(F.when(~a.eqNullSafe(b), 1)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    changed = df.select(*[F.count(F.when(~a.eqNullSafe(t), 1)).alias(f"c{i}") for i, (a, _) in enumerate(pairs[:-1])])
    assert all(n == 0 for n in wrong.first()) and all(n > 20 for n in changed.first())
    for steps in TABLES:
        assert all(signs(p) for p, _ in steps)


def test_signs():
    assert set(re.findall(r"x\{(\w+)\}", signs("(?i)a+b?"))) == {"61", "41"}
    assert signs("x*") is None and signs(r"\S+") is None and signs("(?:ab|c*)") is None
    assert signs(r"^\s+$") == r"\s" and signs("(?<=z)[^q]?k") == r"\x{6b}" and signs(r"[\x{1F000}-\x{1FAFF}]") == r"\x{1f000}-\x{1faff}"
