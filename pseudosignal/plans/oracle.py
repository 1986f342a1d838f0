"""DuckDB statements that compute the catalogue queries independently.

They start from the same driver tables and share no code with the Spark side,
except for the sample keys. Where Spark derives something from text, these derive
it from the numbers the text was made of.
"""

from __future__ import annotations

from pseudosignal.functions.crypto import hmac_pads
from pseudosignal.plans.catalogue import MAX_DEPTH
from pseudosignal.plans.sample_tables import sample_keys
from pseudosignal.schema import RAW_FIELDS

_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_RAW = ", ".join(f'"{name}"' for name in RAW_FIELDS)


def _instant(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _hmac(ipad: str, opad: str, message: str) -> str:
    return f"sha256(unhex({opad}) || unhex(sha256(unhex({ipad}) || encode({message}))))"


def _keys() -> str:
    rows = []
    for key in sample_keys():
        pads = [
            *hmac_pads(key.regional_pepper),
            *hmac_pads(f"{key.bank_salt}|{key.regional_pepper}"),
            *hmac_pads(key.hmac_secret),
        ]
        values = ", ".join(f"'{pad.hex()}'" for pad in pads)
        rows.append(
            f"('{key.institution_id}', {values}, '{key.bank_salt}', {key.reporting_threshold}::DOUBLE)"
        )
    return (
        "keys(institution_id, p_i, p_o, l_i, l_o, s_i, s_o, salt, threshold) AS (VALUES "
        + ", ".join(rows)
        + ")"
    )


def _geohash() -> str:
    """Coordinates are multiples of 1/64, so cell numbers are exact integer divisions."""
    lon = "least(((longitude * 64)::BIGINT + 11520) * 16 // 45, 8191)"
    lat = "least(((latitude * 64)::BIGINT + 5760) * 16 // 45, 4095)"
    chars = []
    for char in range(5):
        bits = []
        for bit in range(5):
            place = char * 5 + bit
            source, shift = (lon, 12 - place // 2) if place % 2 == 0 else (lat, 11 - place // 2)
            bits.append(f"((({source}) >> {shift}) & 1) * {1 << (4 - bit)}")
        chars.append(f"substr('{_ALPHABET}', (1 + {' + '.join(bits)})::BIGINT, 1)")
    return (
        "CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN "
        + " || ".join(chars)
        + " ELSE 'ZONE_UNKNOWN' END"
    )


_RAW_TX = """
base AS (
  SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey % 50 AS bad,
         (o_orderkey * 31 + 7) % 150 AS cp, lpad((22000000000 + o_custkey)::VARCHAR, 11, '0') AS own,
         o_orderdate + to_minutes(o_orderkey % 1440) AS local_time
  FROM orders JOIN customer ON o_custkey = c_custkey
),
timed AS (
  SELECT k AS tx_id, 'BNK_' || (k % 5)::VARCHAR AS institution_id,
    CASE WHEN bad = 1 THEN '   ' ELSE 'CUST-' || c::VARCHAR END AS id,
    CASE WHEN bad = 2 THEN '' WHEN k % 2 = 0 THEN '  ' || lower(c_name) || ' ' ELSE c_name END AS name,
    CASE WHEN c % 3 = 0 THEN NULL
         WHEN k % 5 = 0 THEN own[1:4] || '-' || own[5:8] || ' ' || own[9:11] ELSE own END AS national_id,
    CASE WHEN bad = 3 THEN '' ELSE 'ACC-' || c::VARCHAR END AS account,
    CASE WHEN bad = 4 THEN 0::DOUBLE WHEN bad = 6 THEN -o_totalprice
         ELSE o_totalprice / 32::DOUBLE END AS amount,
    CASE WHEN k % 4 = 0 THEN NULL WHEN bad = 7 THEN 95::DOUBLE
         ELSE ((k * 37) % 11521)::DOUBLE / 64 - 90 END AS latitude,
    CASE WHEN k % 4 = 0 OR bad = 9 THEN NULL WHEN bad = 11 THEN -190::DOUBLE
         ELSE ((k * 91) % 23041)::DOUBLE / 64 - 180 END AS longitude,
    strftime(local_time, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN bad = 13 THEN '' WHEN k % 3 = 0 THEN 'Z' WHEN k % 3 = 1 THEN '+01:00'
              ELSE '.250-05:00' END AS "timestamp",
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'DEV-' || (c % 100)::VARCHAR END AS device_id,
    CASE WHEN k % 11 = 0 THEN 'prehashed_device' END AS device_id_hash,
    '10.0.' || (c % 256)::VARCHAR || '.' || (k % 256)::VARCHAR AS ip,
    CASE WHEN k % 13 = 0 THEN 'prehashed_ip' END AS ip_hash,
    'BR-' || c_nationkey::VARCHAR AS branch_id,
    CASE WHEN k % 7 = 0 THEN '' ELSE 'transaction' END AS signal_type,
    CASE k % 3 WHEN 0 THEN 'ATM' WHEN 1 THEN 'POS' ELSE 'MOBILE_APP' END AS endpoint_type,
    CASE WHEN k % 2 = 0 THEN 'CUST-' || cp::VARCHAR END AS counterparty_id,
    CASE WHEN k % 4 = 0 AND cp % 3 <> 0 THEN lpad((22000000000 + cp)::VARCHAR, 11, '0') END
      AS counterparty_national_id,
    CASE WHEN bad = 13 THEN NULL ELSE epoch(local_time)::BIGINT
         - CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 3600 ELSE -18000 END END AS utc_seconds
  FROM base
),
raw_tx AS (SELECT * FROM timed)
"""

_DECODED = """
decoded AS (
  SELECT tx_id, institution_id, %(fields)s, utc_seconds, decode_error FROM (
    SELECT * REPLACE (%(replace)s, CASE WHEN form = 'null' THEN NULL ELSE utc_seconds END AS utc_seconds)
    FROM (
      SELECT *, CASE WHEN tx_id %% 5000 = 18 THEN 'plain'
                     WHEN tx_id %% 40 = 29 THEN 'null'
                     WHEN tx_id %% 40 = 32 THEN 'cleared' ELSE 'plain' END AS form,
             CASE WHEN tx_id %% 5000 = 17 THEN 'oversize' WHEN tx_id %% 5000 = 18 THEN NULL
                  WHEN tx_id %% 40 IN (21, 22, 26, 27, 28, 30, 33, 34) THEN 'invalid JSON' END
               AS decode_error
      FROM raw_tx)))
""" % {
    "fields": _RAW,
    "replace": ", ".join(
        f"CASE WHEN decode_error IS NOT NULL OR form = 'null'"
        f"{' OR form = ' + repr('cleared') if name == 'latitude' else ''}"
        f' THEN NULL ELSE "{name}" END AS "{name}"'
        for name in RAW_FIELDS
    ),
}


def _judged(source: str, error: str) -> str:
    return f"""
judged AS (
  SELECT *, CASE reject_field
      WHEN 'payload' THEN decode_error
      WHEN 'amount' THEN 'validation error: amount - must be a positive number'
      WHEN 'timestamp' THEN
        'validation error: timestamp - must be RFC 3339 (e.g. 2026-01-15T14:07:33Z)'
      WHEN 'latitude/longitude' THEN
        'validation error: latitude/longitude - must be provided together or omitted together'
      WHEN 'latitude' THEN 'validation error: latitude - must be between -90 and 90'
      WHEN 'longitude' THEN 'validation error: longitude - must be between -180 and 180'
      ELSE 'validation error: ' || reject_field || ' - must be a non-empty string' END AS reject_reason
  FROM (
    SELECT *, CASE
      WHEN decode_error IS NOT NULL THEN 'payload'
      WHEN trim(coalesce(id, '')) = '' THEN 'id'
      WHEN trim(coalesce(name, '')) = '' THEN 'name'
      WHEN trim(coalesce(account, '')) = '' THEN 'account'
      WHEN coalesce(amount, 0) <= 0 THEN 'amount'
      WHEN utc_seconds IS NULL THEN 'timestamp'
      WHEN (latitude IS NULL) <> (longitude IS NULL) THEN 'latitude/longitude'
      WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude'
      WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude' END AS reject_field
    FROM (SELECT *{error} FROM {source})))
"""


_NORMAL = """
normal AS (
  SELECT *, replace(replace(replace(upper(id), '-', ''), '.', ''), ' ', '') AS id_norm,
    trim(upper(name)) AS name_norm,
    coalesce(replace(replace(national_id, '-', ''), ' ', ''), '') AS national_id_norm,
    coalesce(replace(upper(counterparty_id), '-', ''), '') AS counterparty_id_norm,
    coalesce(counterparty_national_id, '') AS counterparty_national_id_norm
  FROM judged JOIN keys USING (institution_id)
)
"""

_SIGNAL_ROWS = f"""
derived AS (
  SELECT *,
    CASE WHEN national_id_norm <> '' THEN {_hmac("p_i", "p_o", "'v2|id|' || national_id_norm")}
         ELSE {_hmac("l_i", "l_o", "'v2|local|' || id_norm || '|' || name_norm")} END AS identity_mosaic,
    CASE WHEN national_id_norm <> '' THEN 'global' ELSE 'local' END AS mosaic_scope,
    CASE WHEN counterparty_national_id_norm <> ''
         THEN {_hmac("p_i", "p_o", "'v2|id|' || counterparty_national_id_norm")}
         WHEN counterparty_id <> ''
         THEN {_hmac("l_i", "l_o", "'v2|local|' || counterparty_id_norm")} END AS destination_mosaic,
    CASE WHEN counterparty_national_id_norm <> '' THEN 'global'
         WHEN counterparty_id <> '' THEN 'local' END AS destination_mosaic_scope,
    sha256(coalesce(account, '') || '|' || salt) AS account_hash,
    coalesce(device_id_hash, sha256(device_id || '|' || salt)) AS device_hash,
    coalesce(ip_hash, sha256(ip || '|' || salt)) AS ip_address_hash,
    CASE WHEN amount <= 500 THEN 'TIER_1' WHEN amount <= 2500 THEN 'TIER_2'
         WHEN amount <= 10000 THEN 'TIER_3' ELSE 'TIER_4' END AS amount_tier,
    CASE WHEN amount >= threshold * 0.95::DOUBLE THEN TRUE END AS is_near_threshold,
    {_geohash()} AS location_zone,
    coalesce({_instant("utc_seconds // 900 * 900")}, 'TIME_UNKNOWN') AS time_bucket
  FROM normal
),
sig AS (
  SELECT tx_id, institution_id, coalesce(nullif(signal_type, ''), 'transaction') AS signal_type,
    identity_mosaic, mosaic_scope, 2::INTEGER AS mosaic_version, time_bucket AS "timestamp",
    destination_mosaic, destination_mosaic_scope, account_hash AS meta_account_hash,
    amount_tier AS meta_amount_tier, branch_id AS meta_branch_id, device_hash AS meta_device_id_hash,
    endpoint_type AS meta_endpoint_type, ip_address_hash AS meta_ip_hash,
    is_near_threshold AS meta_is_near_threshold, location_zone AS meta_location_zone,
    s_i, s_o, id, name, national_id, account, device_id, ip, counterparty_id,
    counterparty_national_id, device_id_hash AS given_device_hash, ip_hash AS given_ip_hash
  FROM derived WHERE reject_field IS NULL
)
"""

_SIGNAL_COLUMNS = (
    "tx_id, institution_id, signal_type, identity_mosaic, mosaic_scope, mosaic_version,"
    ' "timestamp", destination_mosaic, destination_mosaic_scope, meta_account_hash,'
    " meta_amount_tier, meta_branch_id, meta_device_id_hash, meta_endpoint_type, meta_ip_hash,"
    " meta_is_near_threshold, meta_location_zone"
)

_BUCKET_DATE = """CASE WHEN "timestamp" <> 'TIME_UNKNOWN' THEN "timestamp"[1:4] || '-01-01' END"""

_WIRE = """
wire AS (
  SELECT *, '{"institution_id":"' || institution_id || '","signal_type":"' || signal_type
    || '","identity_mosaic":"' || identity_mosaic || '","mosaic_scope":"' || mosaic_scope
    || '","mosaic_version":2,"timestamp":"' || "timestamp" || '","metadata":{"account_hash":"'
    || meta_account_hash || '","amount_tier":"' || meta_amount_tier
    || '","branch_id":"' || meta_branch_id || '"'
    || coalesce(',"device_id_hash":"' || meta_device_id_hash || '"', '')
    || ',"endpoint_type":"' || meta_endpoint_type || '","ip_hash":"' || meta_ip_hash || '"'
    || CASE WHEN meta_is_near_threshold THEN ',"is_near_threshold":true' ELSE '' END
    || ',"location_zone":"' || meta_location_zone || '"}'
    || coalesce(',"destination_mosaic":"' || destination_mosaic
                || '","destination_mosaic_scope":"' || destination_mosaic_scope || '"', '')
    || '}' AS payload
  FROM sig
)
"""

_ATTEMPTS = """
codes AS (
  SELECT tx_id, institution_id, unnest(CASE tx_id % 6 WHEN 0 THEN [201] WHEN 1 THEN [500, 200]
      WHEN 2 THEN [401] WHEN 3 THEN [503, 429, 503] WHEN 4 THEN [NULL, 200] ELSE [] END) AS status_code,
    unnest(CASE tx_id % 6 WHEN 0 THEN [1] WHEN 1 THEN [1, 2] WHEN 2 THEN [1]
      WHEN 3 THEN [1, 2, 3] WHEN 4 THEN [1, 2] ELSE [] END) AS attempt_no
  FROM raw_tx
),
attempts AS (
  SELECT tx_id AS signal_id, institution_id, attempt_no, status_code::INTEGER AS status_code,
    1700000000 + tx_id * 60 + (attempt_no - 1) * 7 AS at_seconds, 10 + tx_id % 50 AS elapsed_ms,
    CASE WHEN status_code IN (200, 201) THEN 'delivered'
         WHEN status_code = 429 OR status_code IS NULL THEN 'retry'
         WHEN status_code // 100 = 4 THEN 'permanent' ELSE 'retry' END AS outcome
  FROM codes
)
"""

_STATE = """
tally AS (
  SELECT signal_id, bool_or(outcome = 'delivered') AS was_delivered,
    bool_or(outcome = 'permanent') AS was_refused, count(*) AS attempts, max(at_seconds) AS last_at
  FROM attempts GROUP BY signal_id
),
state AS (
  SELECT tx_id AS signal_id, institution_id, tx_id AS seq,
    1700000000 + (tx_id * 7919) % 3000 AS queued_at,
    CASE WHEN was_delivered THEN 'delivered' WHEN was_refused THEN 'dead' ELSE 'pending' END AS state,
    coalesce(attempts, 0) AS attempts, last_at, payload
  FROM wire LEFT JOIN tally ON tx_id = signal_id
)
"""

_ADMISSION = f"""
places AS (
  SELECT institution_id, greatest({MAX_DEPTH} - count(*) FILTER (state = 'pending'), 0) AS free
  FROM state WHERE attempts > 0 GROUP BY institution_id
),
admission AS (
  SELECT signal_id, institution_id,
    row_number() OVER (PARTITION BY institution_id ORDER BY queued_at, seq)
      <= coalesce(free, {MAX_DEPTH}) AS admitted
  FROM state LEFT JOIN places USING (institution_id) WHERE attempts = 0
)
"""

_JUDGED_RAW = _judged("raw_tx", ", NULL AS decode_error")
_JUDGED_LINES = _judged("decoded", "")


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",".join(ctes) + select


def _raw(select: str) -> str:
    return _with([_RAW_TX, _JUDGED_RAW], select)


def _derived(select: str) -> str:
    return _with([_RAW_TX, _JUDGED_RAW, _keys(), _NORMAL, _SIGNAL_ROWS], select)


def _wire(select: str) -> str:
    return _with([_RAW_TX, _JUDGED_RAW, _keys(), _NORMAL, _SIGNAL_ROWS, _WIRE], select)


def _delivery(select: str) -> str:
    return _with(
        [_RAW_TX, _JUDGED_RAW, _keys(), _NORMAL, _SIGNAL_ROWS, _WIRE, _ATTEMPTS, _STATE, _ADMISSION],
        select,
    )


def _lines(select: str) -> str:
    return _with(
        [_RAW_TX, _DECODED, _JUDGED_LINES, _keys(), _NORMAL, _SIGNAL_ROWS], select
    )


def _audit() -> str:
    values = " , ".join(
        c.strip()
        for c in _SIGNAL_COLUMNS.split(",")
        if c.strip() not in ("tx_id", "mosaic_version", "meta_is_near_threshold")
    )
    parts = [
        f"SELECT '{f}' AS field, count(nullif({f}, '')) AS checked,"
        f" count(*) FILTER (list_contains([{values}], nullif({f}, ''))) AS equal,"
        f" count(*) FILTER (length({f}) >= 6) AS contained_checked, count(*) FILTER (length({f}) >= 6"
        f" AND len([v FOR v IN [{values}] IF contains(v, {f})]) > 0) AS contained,"
        " 0::BIGINT AS not_a_hash FROM wire"
        for f in (
            "id",
            "name",
            "national_id",
            "account",
            "device_id",
            "ip",
            "counterparty_id",
            "counterparty_national_id",
        )
    ]
    parts += [
        f"SELECT '{name}', count({given}), 0::BIGINT, 0::BIGINT, 0::BIGINT,"
        f" count(*) FILTER (NOT regexp_full_match({given}, '[0-9a-f]{{64}}')) FROM wire"
        for name, given in (("device_id_hash", "given_device_hash"), ("ip_hash", "given_ip_hash"))
    ]
    return " UNION ALL ".join(parts)


def _rollup() -> str:
    return """SELECT "timestamp" AS bucket, meta_location_zone AS location_zone,
        meta_amount_tier AS amount_tier, institution_id, count(*) AS signals,
        count(*) FILTER (meta_is_near_threshold) AS near_threshold_signals
        FROM sig GROUP BY ALL"""


ORACLE: dict[str, str] = {
    "raw_transactions": _raw(f"SELECT tx_id, institution_id, {_RAW} FROM raw_tx"),
    "decode_transactions": _lines(f"SELECT tx_id, institution_id, {_RAW}, decode_error FROM decoded"),
    "read_json_lines": _lines(f"SELECT institution_id, {_RAW}, decode_error FROM decoded"),
    "reject_summary": _lines(
        "SELECT institution_id, reject_field, reject_reason, count(*) AS rejects FROM judged"
        " WHERE reject_field IS NOT NULL GROUP BY ALL"
    ),
    "validate_transactions": _raw(
        "SELECT tx_id, institution_id, reject_field, reject_reason FROM judged"
    ),
    "valid_transactions": _raw(
        f"SELECT tx_id, institution_id, {_RAW} FROM judged WHERE reject_field IS NULL"
    ),
    "rejected_transactions": _raw(
        "SELECT tx_id, institution_id, reject_field, reject_reason FROM judged"
        " WHERE reject_field IS NOT NULL"
    ),
    "normalised_identities": _derived(
        "SELECT tx_id, id_norm, name_norm, national_id_norm, counterparty_id_norm,"
        " counterparty_national_id_norm FROM normal"
    ),
    "identity_mosaics": _derived(
        "SELECT tx_id, identity_mosaic, mosaic_scope, 2::INTEGER AS mosaic_version,"
        " NULL::VARCHAR AS reject_reason FROM derived"
    ),
    "destination_mosaics": _derived(
        "SELECT tx_id, destination_mosaic, destination_mosaic_scope, NULL::VARCHAR AS reject_reason"
        " FROM derived"
    ),
    "salted_hashes": _derived(
        "SELECT tx_id, account_hash, device_hash AS device_id_hash, ip_address_hash AS ip_hash,"
        " NULL::VARCHAR AS reject_reason FROM derived"
    ),
    "amount_tiers": _derived("SELECT tx_id, amount, amount_tier FROM derived"),
    "near_threshold": _derived(
        "SELECT tx_id, amount, is_near_threshold, NULL::VARCHAR AS reject_reason FROM derived"
    ),
    "location_zones": _derived("SELECT tx_id, location_zone FROM derived"),
    "time_buckets": _derived('SELECT tx_id, "timestamp", time_bucket FROM derived'),
    "signals": _derived(f"SELECT {_SIGNAL_COLUMNS} FROM sig"),
    "wire_json": _wire("SELECT tx_id, institution_id, payload FROM wire"),
    "signed_payloads": _wire(
        f"SELECT tx_id, institution_id, payload, {_hmac('s_i', 's_o', 'payload')} AS signature"
        " FROM wire"
    ),
    "receipts": _derived(
        "SELECT tx_id, 'queued' AS status, identity_mosaic[1:16] || '...' AS identity_mosaic,"
        " mosaic_scope FROM sig"
    ),
    "pii_leak_audit": _wire(_audit()),
    "delivery_outcomes": _with(
        [_RAW_TX, _ATTEMPTS],
        "SELECT signal_id, attempt_no::INTEGER AS attempt_no, status_code, outcome FROM attempts",
    ),
    "delivery_state": _delivery(
        f"SELECT signal_id, institution_id, seq, {_instant('queued_at')} AS enqueued_at, state,"
        f" attempts, {_instant('last_at')} AS last_attempt_at FROM state"
    ),
    "dead_letters": _delivery(
        "SELECT signal_id, institution_id, 'rejected' AS reason, payload FROM state"
        " WHERE state = 'dead'"
    ),
    "pending_backlog": _delivery(
        f"SELECT signal_id, institution_id, seq, {_instant('queued_at')} AS enqueued_at, payload"
        " FROM state WHERE state = 'pending' ORDER BY institution_id, queued_at, seq"
    ),
    "queue_heads": _delivery(
        f"SELECT institution_id, {_instant('queued_at')} AS enqueued_at, seq, signal_id, attempts,"
        f" {_instant('last_at')} AS last_attempt_at FROM state WHERE state = 'pending'"
        " QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY queued_at, seq) = 1"
    ),
    "retry_schedule": _delivery(
        "SELECT signal_id, institution_id, attempts AS failures, wait::INTEGER AS wait_seconds,"
        f" {_instant('last_at + wait')} AS next_attempt_at FROM (SELECT *, CASE attempts WHEN 0 THEN 0"
        " WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 30 END AS wait FROM state"
        " WHERE state = 'pending')"
    ),
    "retry_budget": _with(
        [_RAW_TX, _ATTEMPTS],
        "SELECT signal_id, institution_id, count(*) AS attempts,"
        " CASE WHEN bool_or(outcome = 'delivered') THEN 'delivered'"
        " WHEN bool_or(outcome = 'permanent') THEN 'permanent'"
        " WHEN count(*) >= 3 THEN 'exhausted' ELSE 'pending' END AS result,"
        " CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE 750 END::BIGINT AS waited_ms,"
        " sum(elapsed_ms)::BIGINT AS elapsed_ms FROM attempts WHERE attempt_no <= 3"
        " GROUP BY signal_id, institution_id",
    ),
    "admission_control": _delivery(
        "SELECT signal_id, institution_id, admitted,"
        " CASE WHEN NOT admitted THEN 'spool_full' END AS reject_reason FROM admission"
    ),
    "metrics_counters": _delivery(
        """SELECT institution_id, 'queued' AS mode, count(*) FILTER (NOT turned_away) AS signals_processed,
             count(*) FILTER (NOT turned_away AND state = 'delivered') AS signals_forwarded,
             count(*) FILTER (NOT turned_away AND state = 'dead') AS signals_dead_lettered,
             count(*) FILTER (turned_away) AS spool_rejects,
             0::BIGINT AS forward_failures, 0::BIGINT AS processing_time_ms_total
           FROM (SELECT s.*, coalesce(NOT a.admitted, false) AS turned_away
                 FROM state s LEFT JOIN admission a USING (signal_id)) GROUP BY institution_id
           UNION ALL
           SELECT institution_id, 'synchronous', count(*) FILTER (ok), count(*) FILTER (ok), 0, 0,
             count(*) FILTER (NOT ok AND (refused OR n >= 3)),
             coalesce(sum(ms + waits) FILTER (ok), 0)::BIGINT
           FROM (SELECT institution_id, signal_id, bool_or(outcome = 'delivered') AS ok,
                   bool_or(outcome = 'permanent') AS refused, count(*) AS n, sum(elapsed_ms) AS ms,
                   CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE 750 END AS waits
                 FROM attempts WHERE attempt_no <= 3 GROUP BY ALL)
           GROUP BY institution_id"""
    ),
    "backlog_depth": _delivery(
        "SELECT institution_id, count(*) FILTER (state = 'pending') AS spool_depth FROM state"
        " GROUP BY institution_id"
    ),
    "signal_rollup": _derived(_rollup()),
    "cross_institution": _derived(
        "SELECT mosaic_version, identity_mosaic, count(DISTINCT institution_id) AS institutions,"
        " count(*) AS signals FROM sig WHERE mosaic_scope = 'global' GROUP BY ALL"
        " HAVING count(DISTINCT institution_id) >= 2"
    ),
    "within_institution": _derived(
        "SELECT mosaic_version, institution_id, mosaic_scope, identity_mosaic, count(*) AS signals,"
        " count(*) FILTER (meta_is_near_threshold) AS near_threshold_signals,"
        ' min("timestamp") AS first_bucket, max("timestamp") AS last_bucket FROM sig GROUP BY ALL'
        " HAVING count(*) >= 2"
    ),
    "route_links": _derived(
        "SELECT mosaic_version, identity_mosaic, source_institution, transfers, target_institution,"
        " target_signals FROM (SELECT destination_mosaic AS mosaic, institution_id AS"
        " source_institution, count(*) AS transfers FROM sig WHERE destination_mosaic_scope = 'global'"
        " GROUP BY ALL) JOIN (SELECT mosaic_version, identity_mosaic, institution_id AS"
        " target_institution, count(*) AS target_signals FROM sig WHERE mosaic_scope = 'global'"
        " GROUP BY ALL) ON mosaic = identity_mosaic"
    ),
    "shared_fingerprints": _derived(
        " UNION ALL ".join(
            f"SELECT mosaic_version, institution_id, '{kind}' AS kind, meta_{kind} AS hash,"
            " count(DISTINCT identity_mosaic) AS identities, count(*) AS signals FROM sig"
            f" WHERE meta_{kind} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT identity_mosaic) >= 2"
            for kind in ("account_hash", "device_id_hash", "ip_hash")
        )
    ),
    "version_partition": _derived(
        """SELECT version::INTEGER AS mosaic_version, sum(n)::BIGINT AS signals,
             count(*) FILTER (scope = 'global') AS global_identities,
             count(*) FILTER (scope = 'global' AND banks >= 2) AS matched_identities
           FROM (SELECT CASE WHEN tx_id % 10 = 0 THEN 1 ELSE 2 END AS version,
                   CASE WHEN tx_id % 10 = 0 THEN 'none' ELSE mosaic_scope END AS scope,
                   identity_mosaic, count(DISTINCT institution_id) AS banks, count(*) AS n
                 FROM sig GROUP BY ALL) GROUP BY version"""
    ),
    "stream_signals": _lines(f"SELECT {_SIGNAL_COLUMNS} FROM sig"),
    "stream_rejects": _lines(
        "SELECT tx_id, institution_id, reject_field, reject_reason FROM judged"
        " WHERE reject_field IS NOT NULL"
    ),
    "stream_rollup": _lines(_rollup()),
    "stream_counters": _lines(
        "SELECT institution_id, count(*) AS transactions,"
        " count(*) FILTER (reject_field IS NULL) AS signals_processed,"
        " count(*) FILTER (reject_field IS NOT NULL) AS rejected FROM judged GROUP BY institution_id"
    ),
    "stream_windowed_rollup": _derived(_rollup()),
    "stream_admission": _delivery(
        "SELECT signal_id, institution_id, admitted,"
        " CASE WHEN NOT admitted THEN 'spool_full' END AS reject_reason FROM admission"
    ),
    "signal_table": _derived(
        f"SELECT * EXCLUDE (tx_id) REPLACE (CASE institution_id WHEN 'BNK_0' THEN '007' ELSE institution_id"
        f" END AS institution_id) FROM (SELECT {_SIGNAL_COLUMNS}, {_BUCKET_DATE} AS bucket_date FROM sig)"
    ),
    "signal_sink": _derived(
        f"SELECT * EXCLUDE (tx_id) FROM (SELECT {_SIGNAL_COLUMNS}, {_BUCKET_DATE} AS bucket_date FROM sig)"
    ),
}
