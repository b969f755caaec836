"""Word lists and labels of the returns report."""

from __future__ import annotations

# The topics in order of priority with the phrases that name them, the topics that each stated
# reason expects, the labels of corrected reasons, and the comments that say nothing.
TOPIC_KEYWORDS = {
    "SIZE_TOO_LARGE": ["too large", "too big", "too wide", "too long", "too tall", "runs large", "incorrect size", "wrong size", "size is wrong", "too bulky", "size too big", "bigger than", "larger than", "size larger", "bit too big"],
    "SIZE_TOO_SMALL": ["too small", "too tight", "too narrow", "too short", "runs small", "size too small", "smaller than", "too tiny", "not big enough", "too little", "size smaller"],
    "DEFECTIVE": ["defective", "broken", "doesn't work", "does not work", "not work", "broke", "malfunction", "stopped working", "falling off", "falls off", "cracked", "leaking", " leak ", "torn", "ripped", "damaged", "doesnt function", "doesn't function", "no longer work"],
    "QUALITY_ISSUE": ["poor quality", "bad quality", "too thin", "very thin", "flimsy", "not durable", "low quality", "inferior", "terrible quality", "bad material", "quality is bad", "not good quality", "not the same quality", "cheap quality", "quality is poor", "material is thin"],
    "NOT_AS_DESCRIBED": ["not as described", "not as expected", "not what i expected", "misleading", "misrepresented", "inaccurate description"],
    "WRONG_ITEM": ["wrong item", "wrong product", "wrong color", "ordered wrong"],
    "DELIVERY_ISSUE": ["never arrived", "did not arrive", "not delivered", "never received", "late delivery", "delayed", "shipping was", "weeks delayed", "not arrive", "took too long", "not received"],
    "CHANGED_MIND": ["changed mind", "don't need", "do not need", "no longer need", "no longer want", "changed my mind", "don't want", "dont need", "dont want"],
    "BETTER_PRICE": ["found cheaper", "better price", "found better price", "cheaper elsewhere", "cheaper on", "lower price"],
    "SIZE_ISSUE": [" size ", " fit ", " fits ", "fitting", "incorrect size", "wrong size", "doesn't fit", "does not fit", "wont fit", "won't fit"],
}
EXPECTED_TOPICS = {
    "APPAREL_TOO_LARGE": ["SIZE_TOO_LARGE", "SIZE_ISSUE"],
    "APPAREL_TOO_SMALL": ["SIZE_TOO_SMALL", "SIZE_ISSUE"],
    "POOR_FIT": ["SIZE_TOO_LARGE", "SIZE_TOO_SMALL", "SIZE_ISSUE"],
    "DEFECTIVE": ["DEFECTIVE"],
    "NOT_AS_DESCRIBED": ["NOT_AS_DESCRIBED", "QUALITY_ISSUE", "SIZE_TOO_LARGE", "SIZE_TOO_SMALL"],
    "QUALITY_UNACCEPTABLE": ["QUALITY_ISSUE", "DEFECTIVE"],
    "ORDERED_WRONG_ITEM": ["WRONG_ITEM"],
    "UNWANTED_ITEM": ["CHANGED_MIND", "BETTER_PRICE"],
    "FOUND_BETTER_PRICE": ["BETTER_PRICE", "CHANGED_MIND"],
    "MISSING_PARTS": ["DEFECTIVE"],
    "DAMAGED_BY_FC": ["DEFECTIVE"],
    "DAMAGED_BY_CARRIER": ["DEFECTIVE"],
    "NEVER_ARRIVED": ["DELIVERY_ISSUE"],
    "MISSED_ESTIMATED_DELIVERY": ["DELIVERY_ISSUE"],
    "UNDELIVERABLE_UNKNOWN": ["DELIVERY_ISSUE"],
    "UNDELIVERABLE_REFUSED": ["DELIVERY_ISSUE"],
    "NO_REASON_GIVEN": [],
    "SWITCHEROO": ["WRONG_ITEM"],
    "NOT_COMPATIBLE": ["NOT_AS_DESCRIBED", "SIZE_ISSUE"],
    "PART_NOT_COMPATIBLE": ["NOT_AS_DESCRIBED", "SIZE_ISSUE"],
    "MISORDERED": ["WRONG_ITEM"],
    "EXTRA_ITEM": [],
    "EXCESSIVE_INSTALLATION": [],
    "UNAUTHORIZED_PURCHASE": [],
}
TRUE_REASON_LABELS = {
    "SIZE_TOO_LARGE": "SIZE - Too Large",
    "SIZE_TOO_SMALL": "SIZE - Too Small",
    "SIZE_ISSUE": "SIZE - Fit Issue",
    "DEFECTIVE": "DEFECTIVE",
    "QUALITY_ISSUE": "QUALITY ISSUE",
    "NOT_AS_DESCRIBED": "NOT AS DESCRIBED",
    "WRONG_ITEM": "WRONG ITEM",
    "DELIVERY_ISSUE": "DELIVERY ISSUE",
    "CHANGED_MIND": "CHANGED MIND",
    "BETTER_PRICE": "FOUND BETTER PRICE",
}
TRIVIAL_COMMENTS = ["", "na", "n/a", "no", "yes", "z", "return", "ok", "none", ".", "-", "n"]
