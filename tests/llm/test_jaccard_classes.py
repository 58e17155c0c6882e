from fractions import Fraction

import numpy as np
from grainlake.llm import jaccard


def test_low_thresholds_reach_partners_classes_below():
    rng = np.random.default_rng(0)
    for least in (Fraction(1, 2), Fraction(1, 3), Fraction(7, 10)):
        for n in [*range(1, 60), 97, 200, 1001]:
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.sort(rng.permutation(a)[: -int(-len(a) * least // 1)])
            assert set(jaccard.part_keys(a, least, {})) & set(jaccard.part_keys(b, least, {}))
