"""Column expressions on identifiers, hashes, texts, rewards and bits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % quantile of the normal distribution.
Z95 = 1.959963984540054


def repo_key(task: Column) -> Column:
    """The part before the first dot."""
    return F.substring_index(task, ".", 1)


def profile_id(task: Column) -> Column:
    """The part before the last dot; the whole text without one."""
    return F.regexp_replace(task, r"\.[^.]*$", "")


def family(task: Column) -> Column:
    """After the last dot, up to the first double underscore."""
    return F.substring_index(F.substring_index(task, ".", -1), "__", 1)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them; null if a part is null."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit("\u0000"), p.cast("string")]
    return F.sha2(F.concat(*out).cast("binary"), 256)


def seeded_digest(seed: str, key: Column) -> Column:
    return joined_hash(F.lit(seed), key)


def seed_of(digest: Column) -> Column:
    """The number in the first eight hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def slug(text: Column) -> Column:
    """ASCII letters and digits, runs of anything else as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, held within 0 and 1; null without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    share = successes / n
    below = 1 + z * z / n
    centre = share + z * z / (2 * n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    lower, upper = F.greatest(F.lit(0.0), (centre - half) / below), F.least(F.lit(1.0), (centre + half) / below)
    return F.when(trials > 0, lower), F.when(trials > 0, upper)


def confident_levels(trials: int, z: float = Z95) -> list[tuple[int, int]]:
    """Pairs of numbers of successes, the lower first, whose Wilson intervals are disjoint."""

    def bounds(k: int) -> tuple[float, float]:
        p, below = k / trials, 1 + z * z / trials
        half = z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
        centre = p + z * z / (2 * trials)
        return max(0.0, (centre - half) / below), min(1.0, (centre + half) / below)

    ends = [bounds(k) for k in range(trials + 1)]
    return [(i, j) for i in range(trials + 1) for j in range(i + 1, trials + 1) if ends[i][1] < ends[j][0] or ends[j][1] < ends[i][0]]


def feedback_text(valid: Column, passed: Column, total: Column, exit_code: Column, reason: Column, invalid_edit: Column) -> Column:
    """What a rollout is told about the public tests; null counts as not valid, and as no invalid edit."""
    # The wording that ``plans.rollouts.public_status`` reads back.
    said = F.when(
        F.coalesce(valid, F.lit(False)),
        F.concat(F.lit("Public tests: "), passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" passed; exitcode="), exit_code.cast("string"), F.lit(".")),
    ).otherwise(F.concat(F.lit("Public tests unavailable: "), F.coalesce(reason, F.lit("invalid_observation")), F.lit(".")))
    return F.concat(F.when(F.coalesce(invalid_edit, F.lit(False)), "Previous edit was invalid; source unchanged. ").otherwise(""), said)


def disjoint(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (hi_a < lo_b) | (hi_b < lo_a)


def interval_sign(lo: Column, hi: Column) -> Column:
    """1 for a positive interval, -1 for a negative one, 0 if it holds zero."""
    return F.when(lo > 0, 1).when(hi < 0, -1).otherwise(0)


def terminal_reward(solved: Column, score: Column, weight: float = 0.5) -> Column:
    """1 or 0 plus a weighted score; an error for a score outside 0 to 1 or a missing one."""
    y = solved.cast("double")
    bad = score.isNull() | (score < 0) | (score > 1) | solved.isNull()
    return F.when(bad, F.raise_error(F.lit("score missing or out of range")).cast("double")).otherwise(y + weight * score)


def patch_paths(patch: Column, side: str = "a") -> Column:
    """Paths of the changed files in a unified diff: the old side in order of appearance, or the new side.

    On the new side one header that can't be split makes the whole result empty.
    """
    found = F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(.*?) b/(.*)$"), F.lit(1 if side == "a" else 2))
    if side == "a":
        return found
    return F.when(F.size(found) == F.regexp_count(patch, F.lit("(?m)^diff --git ")), found).otherwise(F.slice(found, 1, 0))


def strip_root(path: Column, root: str = "/testbed/") -> Column:
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def tagged_lines(text: Column, tag: str) -> Column:
    """The lines, trimmed and without blank ones, of the first ``<tag>`` block; an empty array without a block."""
    block = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def first_said(text: Column, skip: str = "OBSERVATION:", most: int = 500) -> Column:
    """The first line that is neither blank nor the label ``skip``, cut to ``most`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != skip))
    return F.substring(F.get(lines, 0), 1, most)


def bit_string(values: Column) -> Column:
    """An array of numbers as a text of 1 (above zero) and 0."""
    return F.array_join(F.transform(values, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def bit_agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two texts of bits of one length; null for different lengths."""
    x, y = F.split(a, ""), F.split(b, "")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda z: z))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a))


def bin_means(bits: Column, bins: int, size: int) -> Column:
    """Share of ones in each of ``bins`` neighbouring stretches of ``size`` places."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda k: F.length(F.regexp_replace(F.substr(bits, k * size + 1, F.lit(size)), "0", "")) / F.lit(float(size)),
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clipped_objective(log_ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """Clipped policy objective of one token: the smaller of ratio times advantage and its clipped form."""
    ratio = F.exp(log_ratio)
    return F.least(ratio * advantage, clamp(ratio, 1 - clip, 1 + clip) * advantage)


def kl_estimate(log_ref_ratio: Column) -> Column:
    """exp(r) - r - 1 for the log ratio of reference and policy: never negative."""
    return F.exp(log_ref_ratio) - log_ref_ratio - 1


def fits_once(text: Column, old: Column) -> Column:
    """How often ``old`` occurs in ``text`` without overlap; null for an empty ``old``."""
    return F.when(old != "", F.floor((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """``text`` with its only ``old`` replaced; null unless there is exactly one."""
    return F.when(fits_once(text, old) == 1, F.replace(text, old, new))


def insert_at_line(text: Column, line: Column, new: Column) -> Column:
    """``text`` with ``new`` as a line after line number ``line`` (0: before all); null outside 0 to the line count."""
    lines = F.split(text, "\n")
    with_it = F.concat(F.slice(lines, F.lit(1), line), F.array(new), F.slice(lines, line + 1, F.size(lines)))
    return F.when((line >= 0) & (line <= F.size(lines)), F.array_join(with_it, "\n"))


def first_label(cases: Sequence[tuple[Column, str]], other: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(other)


def matched_labels(text: Column, patterns: Mapping[str, str]) -> Column:
    """Sorted labels of the patterns found in a text, whatever the letter case; an empty array for null."""
    found = F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){p}"), name) for name, p in sorted(patterns.items())])
    return F.array_compact(found)


def fence_body(text: Column) -> Column:
    """The inside of the first code fence, or the text itself without one."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z]*\n(.*?)\n?```", 1)
    return F.when(text.rlike(r"(?s)```[A-Za-z]*\n.*?```"), inside).otherwise(text)
