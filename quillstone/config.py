"""Rule thresholds and vocabularies.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(names, thresholds, message formats); it is stated plainly and in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour)
# ---------------------------------------------------------------------------

HIGH_AMOUNT_THRESHOLD = 500000
RAPID_SECONDS = 5

CHANNELS = ["UPI", "ATM", "NETBANKING", "MOBILE_APP", "POS", "BRANCH"]
TRANSACTION_TYPES = ["DEBIT", "CREDIT", "TRANSFER", "WITHDRAWAL", "PAYMENT"]
STATUS_SUCCESS = "SUCCESS"
STATUS_FAILED = "FAILED"

OUTFLOW_TYPES = ["DEBIT", "WITHDRAWAL", "PAYMENT"]
INFLOW_TYPE = "CREDIT"
PHYSICAL_CHANNELS = ["ATM", "BRANCH"]

# anomaly type -> severity, in first-match order
RULES = [
    ("HIGH_AMOUNT", "HIGH"),
    ("INVALID_ACCOUNT", "CRITICAL"),
    ("NEGATIVE_BALANCE", "HIGH"),
    ("DUPLICATE", "MEDIUM"),
    ("RAPID_TRANSACTIONS", "HIGH"),
    ("LOCATION_MISMATCH", "MEDIUM"),
]
SEVERITY = dict(RULES)

# first-match ("pipeline") message formats; {x} are filled per row
MSG_HIGH_AMOUNT = "Transaction amount ₹{amount} exceeds threshold ₹{threshold}"
MSG_INVALID_ACCOUNT = "Account reference {account_id} does not exist in core banking master ledger"
MSG_NEGATIVE_BALANCE = "Balance after transaction is negative: ₹{balance_after}"
MSG_DUPLICATE = "Duplicate payment collision detected across account, timestamp, and amount"
MSG_RAPID = "Rapid velocity burst on account {account_id} within {seconds}s"
MSG_LOCATION = "Transaction state '{state}' mismatches customer home state '{home_state}'"

# independent ("SQL script") message formats
IND_MSG_HIGH_AMOUNT = "Transaction amount {amount} exceeds maximum single transaction threshold of {threshold}"
IND_MSG_INVALID_ACCOUNT = "Account ID {account_id} does not exist in core banking accounts ledger"
IND_MSG_RAPID = "Rapid velocity transaction detected within {seconds} seconds of previous activity"
IND_MSG_NEGATIVE_BALANCE = "Balance after transaction is negative ({balance_after}) or mathematically impossible"
IND_MSG_DUPLICATE = "Duplicate transaction detected with identical account, timestamp, amount, and type"
IND_MSG_LOCATION = "Transaction location state ({state}) mismatches customer registered home state ({home_state})"

# customer segments (rule order matters; see functions.columns.segment_of)
SEGMENTS = ["STUDENT", "SALARIED", "MASS_MARKET", "AFFLUENT", "PREMIUM", "SENIOR", "SMALL_BUSINESS"]
SEGMENT_DEFAULT_AGE = 30
SEGMENT_DEFAULT_INCOME = 600000
SENIOR_AGE = 60
STUDENT_AGE = 25
STUDENT_INCOME = 500000
PREMIUM_INCOME = 2500000
AFFLUENT_INCOME = 1500000

# star model: age bands
AGE_BANDS = [("Young", 30), ("Mid", 55)]  # else "Senior"
AGE_BAND_ELSE = "Senior"
STAR_CREDIT_TYPE = "Credit"

# trend
MACHINE_EPSILON = 2.220446049250313e-16

# page listing
SORTABLE_COLUMNS = [
    "transaction_date", "transaction_amount", "account_balance",
    "customer_id", "location", "channel", "transaction_type",
]
SEARCH_COLUMNS = ["customer_id", "merchant_id", "location", "channel"]

RISK_HIGH = "HIGH_RISK"
RISK_ELEVATED = "ELEVATED"
RISK_STANDARD = "STANDARD"
PENDING_STATUS = "Pending Data"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleConfig:
    """Tunable parameters of the quality rules.

    ``bucket_seconds`` is the time slice used to split one account's rows
    across tasks for the ordered rules; it must exceed twice the rapid gap.
    """

    high_amount: float = HIGH_AMOUNT_THRESHOLD
    rapid_seconds: int = RAPID_SECONDS
    bucket_seconds: int = 3600

    def __post_init__(self):
        if self.bucket_seconds <= 2 * self.rapid_seconds:
            raise ValueError("bucket_seconds must be larger than 2 * rapid_seconds")


DEFAULT_RULES = RuleConfig()
