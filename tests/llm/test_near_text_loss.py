"""The chance that the pruning steps drop a pair at the threshold."""

import inspect
from math import comb

from lumenframe.llm.near_text import STEP, fewest_matches, near_text


def test_pruning_drops_fewer_true_pairs_than_the_bands_miss():
    live = {0: 1.0}
    for need in fewest_matches(0.8, inspect.signature(near_text).parameters["tolerance"].default):
        after: dict[int, float] = {}
        for m, chance in live.items():
            for new in range(STEP + 1):
                after[m + new] = after.get(m + new, 0) + chance * comb(STEP, new) * 0.8 ** new * 0.2 ** (STEP - new)
        live = {m: chance for m, chance in after.items() if m >= need}
    assert 1 - sum(live.values()) < 1e-6
