"""Lists, weights and thresholds of the two scoring engines."""

from __future__ import annotations

from dataclasses import dataclass, field

# The rule engine's country lists and words.
RULE_HIGH_RISK = ("RU", "IR", "KP", "SY", "CU", "VE", "MM", "BY", "CD", "CF", "LY", "SO", "SS", "YE", "ZW")
RULE_TAX_HAVENS = (
    "KY", "VG", "PA", "CH", "LI", "MC", "AD", "JE", "GG", "IM", "BM", "BS", "BZ", "LU", "MT", "CY", "SG", "HK", "AE",
)
RULE_GREY_LIST = (
    "NG", "PK", "PH", "TZ", "JM", "AL", "BB", "BF", "CM", "HR", "GH", "GI", "HT", "JO", "ML", "MZ", "SN", "UG", "ZA",
)
SANCTION_WORDS = ("russia", "russian", "moscow", "iran", "iranian", "tehran", "korea", "pyongyang", "syria", "syrian")
PEP_INDICATORS = (
    "government", "minister", "president", "senator", "official", "embassy", "state", "political", "military",
)

# The detectors' words and entries.
WATCHED_ENTITIES = (
    "sanctioned_russian_bank", "terror_group_abc", "narcotics_cartel_xyz", "north_korea_trading", "iran_shipping_co",
)
SANCTIONED_ORIGINS = ("IR", "KP", "SY", "CU")
SANCTIONED_ORIGIN_WORDS = ("iran", "korea", "syria", "cuba")
PEP_WORDS = (
    "minister", "gov", "official", "president", "senator", "ambassador", "military", "general", "director",
    "secretary", "parliament", "congress", "royal", "prince", "king", "queen",
)
DARKNET_MARKETS = ("hydra", "alphabay", "dark0de", "versus", "world market")

# Points of a factor by the first of these names in it.
FACTOR_WEIGHTS = (
    ("SANCTIONS", 40), ("PEP", 25), ("CRYPTO_MIXER", 30), ("DARKNET", 35), ("HIGH_RISK", 20), ("TAX_HAVEN", 15),
    ("STRUCTURING", 25), ("VELOCITY", 15), ("TBML", 20), ("DOC", 15), ("NEW_ACCOUNT", 10),
)

# Names of types and states.
TRANSACTION_TYPES = (
    "WIRE_TRANSFER", "ACH", "CRYPTO", "CASH", "CHECK", "CARD", "TRADE_FINANCE",
)
CASE_STATES = ("OPEN", "UNDER_REVIEW", "ESCALATED", "SAR_FILED", "CLOSED_NO_ACTION", "CLOSED_FALSE_POSITIVE")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class RiskSettings:
    """Thresholds of the detector pipeline."""

    low: int = 30
    medium: int = 60
    high: int = 80
    critical: int = 95
    large: int = 10_000
    very_large: int = 100_000
    max_daily_transactions: int = 10
    max_daily_amount: int = 50_000
    new_account_days: int = 30
    high_risk: tuple[str, ...] = field(
        default=("IR", "KP", "SY", "CU", "MM", "RU", "BY", "VE", "ZW", "AF", "YE", "SO", "LY")
    )
    tax_havens: tuple[str, ...] = field(
        default=("KY", "VG", "BM", "PA", "MT", "AE", "JE", "GG", "IM", "BZ", "SC", "MU", "LI", "MC")
    )
    grey_list: tuple[str, ...] = field(default=("PK", "NG", "PH", "TZ", "UG", "JM", "HT", "AL", "BA"))


DEFAULTS = RiskSettings()
