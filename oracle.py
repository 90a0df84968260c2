"""Independent SQL for every query, written for DuckDB over the raw test tables.

It follows the plain relational definition (full outer joins, one union branch per channel, LAG over
all sales of an id, global windows), not the plans of the package, so that agreement means something.
"""

from __future__ import annotations

from sampledata import ACCENTED, SHARED_IDS, VIEWS, view_text

# Fixed values, written here once more: the channels, segments, texts and headers that results must carry.
IFOOD, FOOD99, STORE = "iFood", "99food", "Loja"
SEGMENTS = ((10, "🏆 Campeões (VIP)"), (8, "📈 Clientes Fiéis"), (6, "⚡ Potenciais"), (None, "💤 Em Risco/Perdidos"))
CHAT_LINK = "https://wa.me/"
NEVER = "Nunca"
ZONE = "America/Sao_Paulo"
EXPORT_HEADERS = {
    "name": "Cliente", "primeira_compra": "1ª Compra", "ultima_compra": "Última Compra", "num_compras": "Nº Compras",
    "total_gasto": "Total Gasto", "ticket_medio": "Ticket Médio", "media_frequencia_compra": "Freq Média (dias)",
    "max_dias_sem_recompra": "Máx Dias s/ Compra", "sales_channel": "Canal de Venda", "document_number": "CPF", "phone_number": "Telefone",
}

PARAMETERS = {
    "rfm_as_of": "2001-08-02",
    "cohort_as_of": "1996-01-01",
    "sales_channel": "Loja/iFood",
    "name": "Cliente1",
    "customer_id": "6D6",
    "channel": STORE,
    "segment": "📈 Clientes Fiéis",
    "purpose": "Saudades",
    "shop_name": "Minha Loja",
    "contact_id": "2",
    "process_keys": ["click", "purchase"],
    "document_number": "D6",
    "phone_number": "5511900000005",
    "accented_name": "joão á|ZÉLIA",
}

_IDENTITY = """identity AS (
  SELECT concat(coalesce(c.id, ''), coalesce(n.c_uid, ''), coalesce(s.document_number, '')) AS id,
         coalesce(c.id, n.c_uid) AS customer_id,
         coalesce(n.first_name, c.first_name, s.first_name, '') AS first_name,
         coalesce(n.last_name, c.last_name, s.last_name, '') AS last_name,
         coalesce(c.document_number, s.document_number) AS document_number,
         coalesce(s.phone_number, n.phone_number) AS phone_number,
         c.id AS customer_id_original, n.c_uid AS c_uid_original, s.document_number AS document_number_ctb,
         c.document_number AS document_number_c, s.phone_number AS phone_number_ctb, n.phone_number AS phone_number_c9
  FROM ifood_customer c
  FULL OUTER JOIN store_customer s ON c.document_number = s.document_number
  FULL OUTER JOIN food99_customer n ON s.phone_number = n.phone_number)"""


def _branch(channel: str, fact: str, fact_key: str, total: str, identity_key: str) -> str:
    return (
        f"SELECT i.id, i.first_name || ' ' || i.last_name AS name, coalesce(i.phone_number, '') AS phone_number, "
        f"f.created_at, CAST(f.created_at AS DATE) AS sales_date, f.{total} AS total, '{channel}' AS channel "
        f"FROM {fact} f JOIN identity i ON i.{identity_key} = f.{fact_key}"
    )


_BRANCHES = {
    IFOOD: _branch(IFOOD, "app_orders", "customer_id", "total_bag_detail", "customer_id_original"),
    FOOD99: _branch(FOOD99, "app_orders", "c_uid", "total_bag_detail", "c_uid_original"),
    STORE: _branch(STORE, "store_sales", "client_cpf", "total", "document_number_ctb"),
}


def _sales(channel: str | None = None) -> str:
    chosen = [_BRANCHES[channel]] if channel else list(_BRANCHES.values())
    return "sales AS (" + " UNION ALL ".join(chosen) + ")"


# Sums run on whole hundredths of a cent: sums of doubles depend on the order of the rows.
_UNITS = "CAST(sum(CAST(round(total * 10000) AS BIGINT)) AS BIGINT)"

_GAPS = """gaps AS (
  SELECT *, date_diff('day', lag(sales_date) OVER (PARTITION BY id ORDER BY sales_date, {ties}), sales_date) AS gap
  FROM sales {where})"""

_SUMMARY = f"""summary AS (
  SELECT id, count(*) AS n, {_UNITS} AS units, min(sales_date) AS first_date, max(sales_date) AS last_date,
         CAST(sum(gap) AS BIGINT) AS gap_sum, count(gap) AS gap_n, max(gap) AS gap_max,
         string_agg(DISTINCT channel, '/' ORDER BY channel) AS sales_channel
  FROM gaps GROUP BY id),
listing AS (
  SELECT i.first_name || ' ' || i.last_name AS name,
         strftime(first_date, '%d/%m/%Y') AS primeira_compra, strftime(last_date, '%d/%m/%Y') AS ultima_compra,
         CAST(n AS BIGINT) AS num_compras, units / 10000.0 AS total_gasto,
         ((units + 50 * n) // (100 * n)) / 100.0 AS ticket_medio,
         CASE WHEN n > 1 THEN ((200 * gap_sum + gap_n) // (2 * gap_n)) / 100.0 ELSE 0.0 END AS media_frequencia_compra,
         CAST(CASE WHEN n > 1 THEN gap_max ELSE 0 END AS BIGINT) AS max_dias_sem_recompra,
         sales_channel, i.document_number, i.phone_number, i.id
  FROM identity i JOIN summary USING (id))"""

_LISTING_ORDER = "ORDER BY total_gasto DESC, id, name, document_number NULLS FIRST, phone_number NULLS FIRST"
_LISTING_FILTER = f"WHERE sales_channel = '{PARAMETERS['sales_channel']}' AND name LIKE '%{PARAMETERS['name']}%'"


def _listing() -> list[str]:
    return [_IDENTITY, _sales(), _GAPS.format(ties="channel, total", where=""), _SUMMARY]


def _cohort(channel: str | None = None) -> list[str]:
    as_of = PARAMETERS["cohort_as_of"]
    return [
        _IDENTITY,
        _sales(channel),
        f"kept AS (SELECT id, sales_date FROM sales WHERE sales_date <= DATE '{as_of}')",
        "firsts AS (SELECT id, min(sales_date) AS first_date FROM kept GROUP BY id)",
        f"""counts AS (
  SELECT CAST(date_trunc('month', first_date) AS DATE) AS cohort_month,
         CAST((year(sales_date) - year(first_date)) * 12 + month(sales_date) - month(first_date) + 1 AS BIGINT) AS cohort_index,
         CAST(count(DISTINCT id) AS BIGINT) AS customers
  FROM kept JOIN firsts USING (id)
  WHERE first_date >= CAST(DATE '{as_of}' - INTERVAL 12 MONTH AS DATE)
  GROUP BY ALL)""",
        "matrix AS (SELECT cohort_month, "
        + ", ".join(f"CAST(max(CASE WHEN cohort_index = {i} THEN customers END) AS BIGINT) AS m{i}" for i in range(1, 14))
        + " FROM counts GROUP BY cohort_month)",
    ]


def _rfm(channel: str | None = None) -> list[str]:
    as_of = PARAMETERS["rfm_as_of"]
    return [
        _IDENTITY,
        _sales(channel),
        _GAPS.format(ties="channel, total NULLS FIRST, name", where=f"WHERE sales_date <= DATE '{as_of}'"),
        f"""rfm AS (
  SELECT id, name, max(phone_number) AS phone_number, {_UNITS} / 10000.0 AS monetary, CAST(count(*) AS BIGINT) AS frequency,
         min(sales_date) AS first_purchase, max(sales_date) AS last_purchase,
         CAST(date_diff('day', max(sales_date), DATE '{as_of}') AS BIGINT) AS recency,
         CAST(sum(gap) AS DOUBLE) / CAST(nullif(count(gap), 0) AS DOUBLE) AS avg_cycle,
         string_agg(DISTINCT channel, '/' ORDER BY channel) AS sales_channel
  FROM gaps GROUP BY id, name)""",
    ]


def _edge(column: str, quarter: int) -> str:
    return f"quantile_cont({column}, {quarter / 4}) OVER ()"


_LABELS = " ".join(f"WHEN score >= {floor} THEN '{label}'" for floor, label in SEGMENTS if floor)


def _segments() -> list[str]:
    def above(value: str, edges: str) -> str:
        return " + ".join(f"CAST({value} > {edges}{q} AS INTEGER)" for q in (1, 2, 3))

    edges = ", ".join(f"{_edge(c, q)} AS {c[0]}{q}" for c in ("recency", "monetary") for q in (1, 2, 3))
    ranked = "row_number() OVER (ORDER BY frequency, id, name) AS f_rank, count(*) OVER () AS customers"
    f_above = " + ".join(f"CAST(f_rank > 1 + (customers - 1) * {q} / 4.0 AS INTEGER)" for q in (1, 2, 3))
    return [
        *_rfm(),
        f"edges AS (SELECT *, {edges}, {ranked} FROM rfm)",
        f"""scores AS (
  SELECT *, 4 - ({above('recency', 'r')}) AS r_score, 1 + {f_above} AS f_score,
         1 + {above('monetary', 'm')} AS m_score FROM edges)""",
        f"""segments AS (
  SELECT id, name, phone_number, monetary, frequency, first_purchase, last_purchase, recency, avg_cycle, sales_channel,
         CAST(r_score AS INTEGER) AS r_score, CAST(f_score AS INTEGER) AS f_score, CAST(m_score AS INTEGER) AS m_score,
         CAST(score AS INTEGER) AS rfm_score, CASE {_LABELS} ELSE '{SEGMENTS[-1][1]}' END AS segmento
  FROM (SELECT *, r_score + f_score + m_score AS score FROM scores))""",
    ]


_LAST = "last_contacts AS (SELECT customer_id, max(timestamp) AS last_contact FROM contact_log GROUP BY customer_id)"


def _audience(where: str) -> list[str]:
    return [
        *_segments(),
        _LAST,
        f"""audience AS (
  SELECT s.*, l.last_contact FROM segments s LEFT JOIN last_contacts l ON s.id = l.customer_id
  WHERE length(s.phone_number) > 5 {where})""",
    ]


def _labelled_counts(source: str) -> str:
    names = ", ".join(f"('{label}')" for label in [label for _, label in SEGMENTS])
    return f"""SELECT segmento, CAST(count(s.id) AS BIGINT) AS quantidade
FROM (VALUES {names}) AS l(segmento) LEFT JOIN {source} s USING (segmento) GROUP BY segmento"""


_ONE_SEGMENT = f"AND segmento = '{PARAMETERS['segment']}'"

_FIRST_NAME = "split_part(trim(name), ' ', 1)"
_MESSAGE_TEXTS = {
    "Saudades": f"'Oi ' || {_FIRST_NAME} || '! 🍦 Sentimos sua falta. Já faz ' || CAST(recency AS STRING) || "
    "' dias que você não vem nos visitar. Que tal um açaí hoje para matar a saudade?'",
    "Agradecimento": f"'Olá ' || {_FIRST_NAME} || '! 💜 Passando para agradecer por ser um dos nossos clientes ' || segmento || "
    f"'. Sua preferência no {PARAMETERS['shop_name']} é muito especial para nós!'",
    "Promoção": f"'Fala ' || {_FIRST_NAME} || '! 🎁 Como você é um cliente ' || segmento || "
    "', liberamos um benefício exclusivo para você hoje na loja. Venha conferir!'",
    "Feedback": f"'Olá ' || {_FIRST_NAME} || '! 🌟 Como foi sua última experiência? Sendo um cliente ' || segmento || "
    "', sua opinião nos ajuda a ser cada vez melhores.'",
}


def _messages(purpose: str) -> tuple[list[str], str]:
    parts = [*_audience(_ONE_SEGMENT), _MESSAGES.format(message=_MESSAGE_TEXTS[purpose], purpose=purpose)]
    return parts, f"SELECT *, '{CHAT_LINK}' || phone_clean || '?text=' || replace(url_encode(message_body), '%2F', '/') AS wa_link FROM messages"


_MESSAGES = """digits AS (
  SELECT id, regexp_replace(replace(phone_number, '.0', ''), '[^0-9]', '', 'g') AS digits, {message} AS message_body
  FROM audience),
messages AS (
  SELECT id, CASE WHEN left(digits, 2) <> '55' AND length(digits) >= 10 THEN '55' || digits ELSE digits END AS phone_clean,
         '{purpose}' AS message_type, message_body FROM digits)"""

_CURVE = """curve AS (
  SELECT CAST(row_number() OVER w AS BIGINT) AS position, id, monetary,
         round(100.0 * CAST(sum(CAST(round(monetary * 10000) AS BIGINT)) OVER w AS DOUBLE)
               / CAST(sum(CAST(round(monetary * 10000) AS BIGINT)) OVER () AS DOUBLE), 6) AS cum_perc
  FROM rfm WINDOW w AS (ORDER BY monetary DESC, id, name ROWS UNBOUNDED PRECEDING))"""

_CYCLE = """SELECT CAST(b AS STRING) || '-' || CAST(b + 7 AS STRING) || ' dias' AS faixa, CAST(count(*) AS BIGINT) AS customers
FROM (SELECT CAST(floor(avg_cycle / 7) * 7 AS BIGINT) AS b FROM rfm WHERE avg_cycle > 0) GROUP BY b ORDER BY faixa LIMIT 10"""


def _transaction_text(where: str = "") -> str:
    return f"""SELECT id, channel AS canal, strftime(created_at AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}',
  '%d/%m/%Y %H:%M') AS data_venda, total FROM sales {where}"""


_EXPORT = ", ".join(f'{name} AS "{head}"' for name, head in EXPORT_HEADERS.items())
_MONTHS = ", ".join(f"round(m{i} / CAST(m1 AS DOUBLE), 6) AS m{i}" for i in range(1, 14))
_LATEST = """SELECT strftime(timestamp, '%d/%m/%Y %H:%M') AS timestamp, customer_name, segment, message_type
FROM (SELECT * FROM contact_log ORDER BY contact_log.timestamp DESC LIMIT {n})"""
_NAMES = ", ".join(f"'{key}'" for key in PARAMETERS["process_keys"])

_COUNT_IDS = "SELECT CAST(count(DISTINCT id) AS BIGINT) AS n FROM listing"


def _flag_count(name: str, *columns: str) -> str:
    return f"CAST(count(CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in columns)} THEN 1 END) AS BIGINT) AS {name}"


_APP, _FOOD99, _SHOP = "customer_id_original", "c_uid_original", "document_number_ctb"
_OVERLAP = "SELECT count(*) AS total_cliente, " + ", ".join(
    [
        _flag_count("clientes_ifood", _APP),
        _flag_count("clientes_loja", _SHOP),
        _flag_count("clientes_99food", _FOOD99),
        _flag_count("clientes_loja_99food", _SHOP, _FOOD99),
        _flag_count("clientes_loja_ifood", _SHOP, _APP),
        _flag_count("clientes_ifood_99food", _APP, _FOOD99),
        _flag_count("clientes_loja_ifood_99food", _SHOP, _APP, _FOOD99),
    ]
) + " FROM identity"

_QUEUE = (
    "SELECT id, name, phone_number, sales_channel, segmento, frequency, "
    "strftime(first_purchase, '%d/%m/%Y') AS first_purchase, strftime(last_purchase, '%d/%m/%Y') AS last_purchase, "
    f"coalesce(strftime(last_contact, '%d/%m/%Y %H:%M'), '{NEVER}') AS ultimo_contato FROM audience"
)
_TEXTS = ", ".join(f'CAST({name} AS STRING) AS "{head}"' for name, head in EXPORT_HEADERS.items())


def _percent(month: str) -> str:
    """Exact share in tenths of a percent, halves to the even tenth. No share of the test tables lies so near a half
    that the double of the share would fall on the other side."""
    scaled, rest = f"(1000 * {month}) // m1", f"2 * ((1000 * {month}) % m1)"
    tenths = f"({scaled} + CASE WHEN {rest} > m1 OR ({rest} = m1 AND ({scaled}) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN {month} IS NULL THEN '' ELSE CAST({tenths} // 10 AS STRING) || '.' || CAST({tenths} % 10 AS STRING) || '%' END AS {month}"


def _repeated(registry: str, key: str) -> str:
    return (
        f"SELECT '{registry}' AS registry, '{key}' AS key, CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS repeated_values, "
        f"CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS rows_in_them "
        f"FROM (SELECT count(*) AS n FROM {registry} WHERE {key} IS NOT NULL GROUP BY {key})"
    )


_FACTS = " UNION ALL ".join(
    f"SELECT '{channel}' AS channel, {key} AS native_key, {total} AS total, CAST(created_at AS DATE) AS date FROM {fact} WHERE {key} IS NOT NULL"
    for channel, fact, key, total in (
        (IFOOD, "app_orders", "customer_id", "total_bag_detail"), (FOOD99, "app_orders", "c_uid", "total_bag_detail"), (STORE, "store_sales", "client_cpf", "total"),
    )
)
_ROLLUP = f"""SELECT channel, native_key, CAST(count(*) AS BIGINT) AS sales, {_UNITS} AS units, min(total) AS least,
       bool_or(total IS NULL) AS blank, CAST(date_diff('day', DATE '1970-01-01', date) AS INTEGER) AS day,
       CAST(year(date) * 12 + month(date) - 1 AS INTEGER) AS month
FROM ({_FACTS}) GROUP BY channel, native_key, date"""
_KEYS = (("ifood_customer", "document_number"), ("store_customer", "document_number"), ("store_customer", "phone_number"), ("food99_customer", "phone_number"))
_BY_DOCUMENT = f"WHERE document_number = '{PARAMETERS['document_number']}'"

# name: (relations to define first, final SELECT[, changed views])
_STATEMENTS: dict[str, tuple] = {
    "identity": ([_IDENTITY], "SELECT * FROM identity"),
    "transactions": ([_IDENTITY, _sales()], "SELECT id, sales_date, total, channel FROM sales"),
    "purchase_gaps": (
        _listing()[:3],
        "SELECT id, sales_date, channel, total, CAST(gap AS BIGINT) AS days_between FROM gaps",
    ),
    "channel_overlap": ([_IDENTITY], _OVERLAP),
    "customer_frequency": (_listing(), "SELECT * FROM listing"),
    "customer_frequency_filtered": (_listing(), f"SELECT * FROM listing {_LISTING_FILTER}"),
    "customer_frequency_page": (_listing(), f"SELECT * FROM listing {_LISTING_ORDER} LIMIT 25 OFFSET 25"),
    "customer_frequency_export": (_listing(), f"SELECT {_EXPORT} FROM listing"),
    "customer_count": (_listing(), _COUNT_IDS),
    "customer_count_filtered": (_listing(), f"{_COUNT_IDS} {_LISTING_FILTER}"),
    "customer_page_count": (
        _listing(),
        "SELECT CAST(count(DISTINCT id) AS BIGINT) AS total, CAST(ceil(count(DISTINCT id) / 25.0) AS BIGINT) AS total_pages FROM listing",
    ),
    "customer_transactions": ([_IDENTITY, _sales()], _transaction_text(f"WHERE id = '{PARAMETERS['customer_id']}'")),
    "customer_transactions_all": ([_IDENTITY, _sales()], _transaction_text()),
    "cohort_counts": (_cohort(), "SELECT * FROM counts"),
    "cohort_counts_channel": (_cohort(PARAMETERS["channel"]), "SELECT * FROM counts"),
    "cohort_matrix": (_cohort(), "SELECT * FROM matrix"),
    "cohort_retention": (_cohort(), f"SELECT strftime(cohort_month, '%Y-%m') AS cohort_month, {_MONTHS} FROM matrix"),
    "rfm_base": (_rfm(), "SELECT * FROM rfm"),
    "rfm_channel": (_rfm(PARAMETERS["channel"]), "SELECT * FROM rfm"),
    "rfm_segments": (_segments(), "SELECT * FROM segments"),
    "segment_counts": (_segments(), _labelled_counts("segments")),
    "segment_labels": (_segments(), "SELECT DISTINCT segmento FROM segments"),
    "segment_listing": (
        _segments(),
        "SELECT name, phone_number, monetary, frequency, recency, segmento, sales_channel FROM segments",
    ),
    "abc_curve": ([*_rfm(), _CURVE], "SELECT * FROM curve"),
    "abc_summary": (
        [*_rfm(), _CURVE],
        "SELECT CAST(count(CASE WHEN cum_perc <= 80 THEN 1 END) AS BIGINT) AS vip_count, count(*) AS total_count, "
        "round(100.0 * count(CASE WHEN cum_perc <= 80 THEN 1 END) / count(*), 6) AS vip_percent FROM curve",
    ),
    "repurchase_cycle": (_rfm(), _CYCLE),
    "repurchase_cycle_mean": (_rfm(), "SELECT round(avg(avg_cycle), 6) AS mean_days FROM rfm WHERE avg_cycle > 0"),
    "last_contact": ([_LAST], "SELECT * FROM last_contacts"),
    "contact_history": (
        [],
        "SELECT strftime(timestamp, '%d/%m/%Y %H:%M') AS timestamp, message_type, message_body "
        f"FROM contact_log WHERE customer_id = '{PARAMETERS['contact_id']}'",
    ),
    "latest_events": ([], _LATEST.format(n=50)),
    "latest_events_10": ([], _LATEST.format(n=10)),
    "campaign_queue": (_audience(_ONE_SEGMENT), _QUEUE),
    "campaign_queue_named": (_audience(""), f"{_QUEUE} WHERE regexp_matches(name, '{PARAMETERS['accented_name']}', 'i')", ACCENTED),
    "campaign_segment_counts": (_audience(""), _labelled_counts("audience")),
    "campaign_messages": _messages(PARAMETERS["purpose"]),
    "campaign_messages_thanks": _messages("Agradecimento"),
    "campaign_messages_offer": _messages("Promoção"),
    "campaign_messages_feedback": _messages("Feedback"),
    "process_last_run": ([], f"SELECT * FROM process_last_run WHERE process_key IN ({_NAMES})"),
    "contact_log_append": ([], "SELECT * FROM contact_log"),
    "contact_log_folded": ([], "SELECT * FROM contact_log"),
    "contact_log_streamed": ([], "SELECT * FROM contact_log"),
    "last_contact_streamed": ([_LAST], "SELECT * FROM last_contacts"),
    "rfm_base_shared_ids": (_rfm(), "SELECT * FROM rfm", SHARED_IDS),
    "customer_frequency_by_document": (_listing(), f"SELECT * FROM listing {_BY_DOCUMENT}"),
    "customer_frequency_by_phone": (_listing(), f"SELECT * FROM listing WHERE phone_number = '{PARAMETERS['phone_number']}'"),
    "customer_count_by_document": (_listing(), f"{_COUNT_IDS} {_BY_DOCUMENT}"),
    "customer_frequency_deep_page": (_listing(), f"SELECT * FROM listing {_LISTING_ORDER} LIMIT 20 OFFSET 80"),
    "customer_frequency_csv": (_listing(), f"SELECT {_TEXTS} FROM listing"),
    "cohort_retention_text": (
        _cohort(), f"SELECT strftime(cohort_month, '%Y-%m') AS cohort_month, {', '.join(_percent(f'm{i}') for i in range(1, 14))} FROM matrix"
    ),
    "process_run_text": ([], f"SELECT name, strftime(last_run_date, '%d/%m/%Y %H:%M:%S') AS last_run FROM process_last_run WHERE process_key IN ({_NAMES})"),
    "transactions_clustered": ([_IDENTITY, _sales()], "SELECT id, sales_date, total, channel FROM sales"),
    "customer_transactions_clustered": ([_IDENTITY, _sales()], _transaction_text(f"WHERE id = '{PARAMETERS['customer_id']}'")),
    "daily_rollup": ([], _ROLLUP),
    "rollup_refreshed": ([], _ROLLUP),
    "customer_frequency_rollup": (_listing(), "SELECT * FROM listing"),
    "customer_count_rollup": (_listing(), _COUNT_IDS),
    "rfm_base_rollup": (_rfm(), "SELECT * FROM rfm"),
    "cohort_counts_rollup": (_cohort(), "SELECT * FROM counts"),
    "duplicate_keys": ([], " UNION ALL ".join(_repeated(*pair) for pair in _KEYS)),
}


def statements() -> dict[str, str]:
    out = {}
    for name, (parts, final, *changed) in _STATEMENTS.items():
        views = [f"{view} AS ({view_text(view, *changed)})" for view in VIEWS]
        out[name] = "WITH " + ",\n".join(views + parts) + "\n" + final
    return out
