"""Institution keys: held on the driver, sent to executors as a small broadcast table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.functions.crypto import hmac_pads

# A row is under 1 KiB, so the broadcast stays under 100 MiB.
MAX_BROADCAST_INSTITUTIONS = 100_000
MIN_SALT_CHARS = 32

KEY_COLUMNS = (
    "pepper_ipad",
    "pepper_opad",
    "local_ipad",
    "local_opad",
    "signing_ipad",
    "signing_opad",
    "bank_salt",
    "reporting_threshold",
)


@dataclass(frozen=True)
class InstitutionKeys:
    """Secrets and reporting limit of one institution. Secrets are not in the repr."""

    institution_id: str
    bank_salt: str = field(repr=False)
    regional_pepper: str = field(repr=False)
    hmac_secret: str = field(repr=False)
    reporting_threshold: float = 10_000.0


class KeyRing:
    """Key table of all institutions, with its size known on the driver."""

    def __init__(self, table: DataFrame, size: int):
        self._table = table
        self.size = size

    def __repr__(self) -> str:
        return f"KeyRing({self.size} institutions)"

    @property
    def fits_broadcast(self) -> bool:
        return self.size <= MAX_BROADCAST_INSTITUTIONS

    def small(self, df: DataFrame) -> DataFrame:
        """Broadcast a table of at most one row per institution, if that is small enough."""
        return F.broadcast(df) if self.fits_broadcast else df

    def table(self, *columns: str) -> DataFrame:
        """Institution and the named key columns only; the others stay on the driver."""
        unknown = set(columns) - set(KEY_COLUMNS)
        if unknown:
            raise ValueError(f"no such key columns: {sorted(unknown)}")
        return self._table.select("institution_id", *columns)


def key_ring(
    spark: SparkSession,
    institutions: Iterable[InstitutionKeys],
    min_salt_chars: int = MIN_SALT_CHARS,
) -> KeyRing:
    """Build the key table. Executors get HMAC pads, the salt and the threshold.

    The rows travel as a local relation: their values appear neither in query plans
    nor in the event log. The table must never be written, cached to disk or shown.
    """
    rows = list(institutions)
    seen: set[str] = set()
    for row in rows:
        if not row.institution_id:
            raise ValueError("institution_id must not be empty")
        if row.institution_id in seen:
            raise ValueError(f"duplicate institution: {row.institution_id}")
        seen.add(row.institution_id)
        if not row.regional_pepper or not row.hmac_secret or not row.bank_salt:
            raise ValueError(f"{row.institution_id}: salt, pepper and signing secret are required")
        if len(row.bank_salt) < min_salt_chars:
            raise ValueError(
                f"{row.institution_id}: bank_salt must have at least {min_salt_chars} characters"
            )
    pepper = [hmac_pads(r.regional_pepper) for r in rows]
    local = [hmac_pads(f"{r.bank_salt}|{r.regional_pepper}") for r in rows]
    signing = [hmac_pads(r.hmac_secret) for r in rows]
    table = pa.table(
        {
            "institution_id": pa.array([r.institution_id for r in rows], pa.string()),
            "pepper_ipad": pa.array([i for i, _ in pepper], pa.binary()),
            "pepper_opad": pa.array([o for _, o in pepper], pa.binary()),
            "local_ipad": pa.array([i for i, _ in local], pa.binary()),
            "local_opad": pa.array([o for _, o in local], pa.binary()),
            "signing_ipad": pa.array([i for i, _ in signing], pa.binary()),
            "signing_opad": pa.array([o for _, o in signing], pa.binary()),
            "bank_salt": pa.array([r.bank_salt for r in rows], pa.string()),
            "reporting_threshold": pa.array(
                [float(r.reporting_threshold) for r in rows], pa.float64()
            ),
        }
    )
    return KeyRing(spark.createDataFrame(table), len(rows))


def attach_keys(df: DataFrame, ring: KeyRing, *columns: str) -> DataFrame:
    """Left join with the key columns; ``_has_key`` says whether the institution is known."""
    keys = ring.table(*columns).withColumn("_has_key", F.lit(True))
    return df.join(ring.small(keys), "institution_id", "left")
