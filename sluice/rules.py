"""What a caller may change about the rules, with the fixed values as defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from sluice.functions import fixed


@dataclass(frozen=True)
class Rules:
    """Word lists, thresholds and parity switches of one gate.

    ``alias_rows_everywhere``, ``truncate_time`` and ``collapse_null_keys``
    choose between the documented behaviour and literal parity (see README).
    """

    sentinels: tuple[str, ...] = fixed.SENTINELS
    column_sentinels: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    true_words: tuple[str, ...] = fixed.TRUE_WORDS
    false_words: tuple[str, ...] = fixed.FALSE_WORDS
    country_aliases: Mapping[str, str] = field(default_factory=lambda: dict(fixed.COUNTRY_ALIASES))
    missing_bands: Mapping[str, tuple] = field(default_factory=lambda: dict(fixed.MISSING_BANDS))
    sentinel_bands: tuple = fixed.SENTINEL_BANDS
    non_numeric_bands: tuple = fixed.NON_NUMERIC_BANDS
    email_bands: tuple = fixed.EMAIL_BANDS
    date_bands: tuple = fixed.DATE_BANDS
    # Shares of the present cells from which a text column is of a type.
    number_share: float = 0.8
    truth_share: float = 0.9
    email_share: float = 0.8
    named_email_share: float = 0.3
    day_share: float = 0.8
    # Outliers lie outside so many interquartile ranges and beyond so many medians; of another unit beyond more.
    outlier_fence: float = 3.0
    far_medians: float = 10
    unit_medians: float = 20
    pass_score: int = fixed.PASS_SCORE
    min_rows_retained: float = fixed.MIN_ROWS_RETAINED
    max_categories: int = 12
    alias_rows_everywhere: bool = False
    always_normalise_country: bool = False
    truncate_time: bool = False
    collapse_null_keys: bool = False
    outlier_drop_fence: float = 1.5
    # Most rows one task is asked to rank when a quantile is settled exactly.
    quantile_rows_per_task: int = 50_000
    # Largest lookup (in rows of a key or two) that is ever broadcast; larger ones are shuffled.
    broadcast_rows: int = 2_000_000
    # The same in bytes of its values.
    broadcast_bytes: int = 128 << 20
    # Tables up to this size, as the optimizer estimates it, are cached while they are inspected.
    small_table_bytes: int = 256 << 20
    # approximate distinct counts and quartiles instead of exact ones
    approximate: bool = False

    def sentinels_for(self, column: str) -> tuple[str, ...]:
        return tuple(self.column_sentinels.get(column, self.sentinels))


DEFAULT_RULES = Rules()
