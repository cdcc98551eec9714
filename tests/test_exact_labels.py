"""Labels that stand on the exact value of a double."""

import random

from sonoshelf.functions import labels

from .test_labels import values


def test_one_digit_is_printfs(spark):
    r = random.Random(1)
    rows = [177_120 / 86_400, 0.25, 0.75, 0.35, 2.45, 3.0, 0.0, -0.04, -2.55, 999.95, 1e12 + 0.25, 1e17, *[k / 20 for k in range(400)], *[r.uniform(0, 10.0 ** r.randrange(14)) for _ in range(500)]]
    assert values(spark, "v double", [*rows, None], labels.one_digit) == [f"{x:.1f}" for x in rows] + [None]


def test_labels_round_the_exact_value(spark):
    assert values(spark, "v double", [177_120.0, 194_400.0], labels.rough) == ["~2.0 days", "~2.2 days"]
    assert values(spark, "v long", [1_050_000, 1_250_000, 1_350_000], labels.compact) == ["1.1M", "1.2M", "1.4M"]
    assert values(spark, "v long", [1024 + 256, 1024 + 768], labels.size) == ["1.2 KB", "1.8 KB"]
    assert values(spark, "a int, b int", [(1280, 1792)], labels.memory) == ["1.2 / 1.8 GB"]
