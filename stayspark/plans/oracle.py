"""DuckDB SQL for the input views and the cleaning, used as the oracle.

Each registered query gets an SQL text built as ``WITH <views> <query>``.
The cleaning is re-stated in SQL from the same rules (not generated from
the Spark plan), so a mistake in one engine shows up as a mismatch.
"""

from __future__ import annotations

US = "format('{:,.2f}', o_totalprice)"

BOOKINGS_RAW = f"""bookings_raw AS (
  SELECT o_orderkey AS R_ID,
    CASE o_orderkey % 11 WHEN 0 THEN 'Annuled' WHEN 1 THEN 'Unavailable' WHEN 2 THEN 'Open'
         WHEN 3 THEN 'Pending' WHEN 4 THEN NULL
         ELSE CASE WHEN o_orderstatus = 'F' THEN 'Fact.' ELSE 'Booked' END END AS R_STATUS,
    strftime(o_orderdate, '%d/%m/%Y') AS R_ARRIVAL,
    strftime(o_orderdate + to_days(CAST(1 + o_orderkey % 7 AS INT)), '%d/%m/%Y') AS R_DEPARTURE,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '5d' ELSE CAST(1 + o_orderkey % 7 AS VARCHAR) END AS R_NIGHTS,
    CASE o_orderkey % 4 WHEN 0 THEN concat({US}, ' EUR') WHEN 1 THEN {US}
         WHEN 2 THEN concat(translate({US}, ',.', '.,'), ' €')
         ELSE replace({US}, ',', '') END AS R_TOTAL_AMOUNT,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE n_name || ' ' || CAST(c_custkey % 8 AS VARCHAR) END AS R_PROPERTY_NAME,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'booking.com' WHEN o_orderpriority = '2-HIGH' THEN 'AIRBNB es'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'vrbo' WHEN o_orderpriority = '5-LOW' THEN 'caty'
         WHEN o_orderkey % 3 = 0 THEN 'agencia DEL sol' ELSE NULL END AS R_SOURCE,
    c_name AS R_GUEST_NAME
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# Python str.strip / str.split whitespace, written out for RE2.
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def money(x: str) -> str:
    s = strip(x)
    norm = (f"CASE WHEN instr({s}, '.') > 0 AND instr({s}, ',') > 0 AND instr({s}, '.') < instr({s}, ',') "
            f"THEN replace(replace({s}, '.', ''), ',', '.') "
            f"WHEN instr({s}, '.') > 0 AND instr({s}, ',') > 0 THEN replace({s}, ',', '') "
            f"WHEN instr({s}, ',') > 0 THEN replace({s}, ',', '.') ELSE {s} END")
    return (f"CASE WHEN {s} IS NULL OR {s} = '' OR {s} = 'nan' THEN 0.0 "
            f"ELSE coalesce(TRY_CAST(regexp_replace({norm}, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0.0) END")


FORMATS = ["%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y %H:%M:%S"]


def _elect(c: str) -> str:
    arms = " ".join(f"WHEN count(try_strptime({c}, '{f}')) * 2 > count(*) THEN {i}"
                    for i, f in enumerate(FORMATS))
    return f"CASE {arms} ELSE -1 END"


def _parse(c: str, e: str) -> str:
    arms = " ".join(f"WHEN {i} THEN try_strptime({c}, '{f}')" for i, f in enumerate(FORMATS))
    return f"CASE {e} {arms} END"


MONTHS_SHORT = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
MONTHS_LONG = ("['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre',"
               "'Octubre','Noviembre','Diciembre']")
SEASONS = ("['Invierno','Invierno','Primavera','Primavera','Primavera','Verano','Verano','Verano',"
           "'Otoño','Otoño','Otoño','Invierno']")
DOWS = "['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo']"
HOLIDAYS = "('01-01','01-06','03-19','04-18','05-01','08-15','10-12','11-01','12-06','12-08','12-25')"


def _channel(s: str) -> str:
    st = strip(s)
    return (f"CASE WHEN {s} IS NULL OR {st} IN ('', 'nan', '<NULL>') THEN 'Directo / Sin canal' "
            f"WHEN regexp_matches({s}, '(?i)booking') THEN 'Booking.com' "
            f"WHEN regexp_matches({s}, '(?i)airbnb') THEN 'Airbnb' "
            f"WHEN regexp_matches({s}, '(?i)homeaway|vrbo') THEN 'HomeAway/VRBO' "
            f"WHEN regexp_matches({s}, '(?i)^oh$') THEN 'Other Holiday' "
            f"WHEN regexp_matches({s}, '(?i)manual|caty|maria') THEN 'Manual / Directo' "
            f"WHEN regexp_matches({s}, '(?i)limp') THEN 'Limpieza/Bloqueo' "
            f"ELSE array_to_string(list_transform(string_split(lower({st}), ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' ') END")


BOOKINGS_CLEAN = f"""b_text AS (
  SELECT R_ID AS id, R_STATUS AS status, R_ARRIVAL AS arrival_s, R_DEPARTURE AS departure_s,
         R_NIGHTS AS nights_s, R_TOTAL_AMOUNT AS amount_s, R_PROPERTY_NAME AS property,
         R_SOURCE AS source, R_GUEST_NAME AS guest
  FROM bookings_raw),
b_elect AS (SELECT {_elect('arrival_s')} AS e_arr, {_elect('departure_s')} AS e_dep FROM b_text),
b_parsed AS (
  SELECT id, status, {_parse('arrival_s', 'e_arr')} AS arrival, {_parse('departure_s', 'e_dep')} AS departure,
         nights_s, {money('amount_s')} AS amount, property, source, guest
  FROM b_text CROSS JOIN b_elect),
b_enriched AS (
  SELECT id, status, arrival, departure,
    coalesce(TRY_CAST(nights_s AS DOUBLE),
             CAST(floor(date_diff('second', arrival, departure) / 86400.0) AS DOUBLE)) AS nights,
    amount, property, source, guest,
    CASE WHEN status IS NULL THEN 'Desconocido'
         WHEN status IN ('Booked', 'Fact.') THEN 'Confirmada'
         WHEN status IN ('Declined', 'Annuled', 'annuled', 'Anulled', 'Cancelled') THEN 'Cancelada'
         WHEN status IN ('Unavailable', 'Cleaning') THEN 'Bloqueada'
         WHEN status IN ('Open', 'Tentative') THEN 'Abierta' ELSE 'Otro' END AS status_group,
    {_channel('source')} AS channel,
    CAST(month(arrival) AS INTEGER) AS month,
    {MONTHS_LONG}[month(arrival)] AS month_name,
    {MONTHS_SHORT}[month(arrival)] AS month_short,
    CAST(year(arrival) AS INTEGER) AS year,
    'Q' || CAST(quarter(arrival) AS VARCHAR) AS quarter,
    {SEASONS}[month(arrival)] AS season,
    {DOWS}[isodow(arrival)] AS dow,
    CAST(weekofyear(arrival) AS INTEGER) AS week_num,
    coalesce(isodow(arrival) >= 5, false) AS is_weekend,
    coalesce(strftime(arrival, '%m-%d') IN {HOLIDAYS}, false) AS is_holiday,
    strftime(arrival, '%Y-%m') AS year_month
  FROM b_parsed),
b_q AS (SELECT {{Q1}} AS q1, {{Q3}} AS q3 FROM b_enriched),
bookings_clean AS (
  SELECT e.* EXCLUDE (status_group, channel, month, month_name, month_short, year, quarter, season, dow,
                      week_num, is_weekend, is_holiday, year_month),
    status_group, channel,
    CASE WHEN nights > 0 AND amount > 0 THEN amount / nights END AS price_per_night,
    month, month_name, month_short, year, quarter, season, dow, week_num, is_weekend, is_holiday, year_month,
    coalesce(amount < q1 - 3 * (q3 - q1) OR amount > q3 + 3 * (q3 - q1), false) AS _is_outlier
  FROM b_enriched e CROSS JOIN b_q),
bookings AS (
  SELECT * FROM bookings_clean WHERE status_group = 'Confirmada' AND amount > 0)"""

BOOKINGS_WITH = "WITH " + BOOKINGS_RAW + ",\n" + BOOKINGS_CLEAN

HAS_NULLS_COLS = ["id", "status", "arrival", "departure", "nights", "amount", "property", "source",
                  "guest", "status_group", "channel", "price_per_night", "month", "month_name",
                  "month_short", "year", "quarter", "season", "dow", "week_num", "is_weekend",
                  "is_holiday", "year_month", "_is_outlier"]
HAS_NULLS = "(" + " OR ".join(f"{c} IS NULL" for c in HAS_NULLS_COLS) + ")"


def with_bookings(sql: str) -> str:
    return BOOKINGS_WITH + "\n" + sql


LINEITEM_DIMS = """lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey"""

MARKET = f"""market AS (
  SELECT p_name AS nombre, CAST(floor(l_extendedprice) AS INT) AS precio_noche,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 4.0E0 + (l_partkey % 100) / 100.0E0 END AS rating,
    CAST(l_partkey % 300 AS INT) AS num_reviews, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE p_type END AS tipo, CAST(1 + p_size % 8 AS INT) AS capacidad,
    concat('https://example.com/rooms/', CAST(l_partkey AS VARCHAR)) AS url,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS checkin, l_orderkey, l_linenumber, n_name AS ciudad
  FROM {LINEITEM_DIMS})"""

CARDS = f"""cards AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN concat('Apartamento en ', n_name)
         ELSE concat('Casa ', p_name, ' ', n_name) END AS title_raw,
    CASE WHEN l_partkey % 5 = 0 THEN NULL
         ELSE concat(CAST(CAST(floor(l_extendedprice / 100) AS INT) AS VARCHAR), ' € en total') END AS price_raw,
    concat('Superanfitrión', chr(10), 'Refugio ', p_name, ' con vistas', chr(10),
      CASE WHEN l_partkey % 7 = 0 THEN 'Valoración media de 4,81 sobre 5'
           ELSE concat('4,', lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0'), ' (', CAST(l_partkey % 300 AS VARCHAR), ')') END,
      chr(10),
      CASE p_type WHEN 'ECONOMY' THEN 'Habitación privada' WHEN 'SMALL' THEN 'Cabaña'
           WHEN 'LARGE' THEN 'Casa entera' WHEN 'PROMO' THEN 'Camping' ELSE 'Apartamento entero' END,
      chr(10), CAST(1 + p_size % 8 AS VARCHAR), ' huéspedes', chr(10),
      CAST(CAST(floor(l_extendedprice / 1000) AS INT) AS VARCHAR), ' € noche') AS text,
    CASE WHEN l_partkey % 2 = 0 THEN concat('/rooms/', CAST(l_partkey AS VARCHAR))
         ELSE concat('https://example.com/rooms/', CAST(l_partkey AS VARCHAR)) END AS href,
    1 + l_orderkey % 6 AS nights, n_name AS ciudad
  FROM {LINEITEM_DIMS})"""


def rnd(x: str, d: int = 2) -> str:
    """Half-even rounding of the shortest decimal form of a double, exactly
    as Spark's ``bround`` on doubles (DuckDB's ``round_even`` works in
    binary floating point and differs on some values)."""
    dec = f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20))"
    s = f"({dec} * CAST({10 ** d} AS DECIMAL(18,0)))"
    return (f"CAST(CAST(CASE WHEN {s} - floor({s}) > 0.5 THEN floor({s}) + 1 "
            f"WHEN {s} - floor({s}) < 0.5 THEN floor({s}) "
            f"WHEN floor({s}) % 2 = 0 THEN floor({s}) ELSE floor({s}) + 1 END AS VARCHAR) || 'e-{d}' AS DOUBLE)")


def q_list(lst: str, p: float) -> str:
    """numpy 'linear' quantile of a sorted DuckDB list."""
    n = f"len({lst})"
    h = f"(({n} - 1) * CAST({float(p)!r} AS DOUBLE))"
    a = f"{lst}[CAST(floor({h}) AS BIGINT) + 1]"
    b = f"{lst}[CAST(ceil({h}) AS BIGINT) + 1]"
    t = f"({h} - floor({h}))"
    return (f"CASE WHEN {n} = 0 THEN NULL WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {t}) "
            f"ELSE {a} + ({b} - {a}) * {t} END")


def q_agg(col: str, p: float) -> str:
    """Aggregate form: quantile of the non-NULL values of ``col``."""
    return q_list(f"list_sort(list(CAST({col} AS DOUBLE)) FILTER (WHERE {col} IS NOT NULL))", p)


BOOKINGS_CLEAN = BOOKINGS_CLEAN.replace("{Q1}", q_agg("amount", 0.25)).replace("{Q3}", q_agg("amount", 0.75))
BOOKINGS_WITH = "WITH " + BOOKINGS_RAW + ",\n" + BOOKINGS_CLEAN


def with_bookings(sql: str, *more: str) -> str:  # noqa: F811  (needs the final BOOKINGS_WITH)
    extra = "".join(",\n" + m for m in more)
    return BOOKINGS_WITH + extra + "\n" + sql


def with_views(sql: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + sql
