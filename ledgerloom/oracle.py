"""The engine's queries as SQL for DuckDB over the same tables.

The statements share one chain of common table expressions, from the order tables to states, groups and exceptions.
"""

from __future__ import annotations

from datetime import date

from . import views


def _rows(names: str, rows: list[tuple]) -> str:
    """A list of the views as a table of the chosen customers."""
    text = lambda x: str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT c, x.* FROM chosen, (VALUES {values}) x({names})"


VIEWS = f"""
chosen AS (
  SELECT CAST(c_custkey AS BIGINT) AS c FROM customer WHERE c_custkey % {views.SCENE_EVERY} = {views.SCENE_REST}),
items AS ({_rows("scene, batch, n, type, gross, fee, day, conflict", views.ITEMS)}),
lines AS ({_rows("scene, line, amount, currency, day, names, conflict", views.LINES)}),
booked AS ({_rows("scene, n, type, gross, day", views.BOOKED)}),
""" + """
base0 AS (
  SELECT o_orderkey AS k, c_nationkey AS nation, n_regionkey AS region, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN c_nationkey % 5 = 0 THEN CASE WHEN (o_orderkey // 4) % 2 = 0 THEN 990 ELSE 2500 END
      ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS minor
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
base AS (
  SELECT k, nation, region, day, k % 20 = 0 AS refund,
    CAST(CASE WHEN k % 20 = 0 THEN -(minor // 10) ELSE minor END AS BIGINT) AS amount FROM base0),
all_ledger AS (
  SELECT 'L-' || k AS record_id, CASE WHEN refund THEN 'REFUND' ELSE 'SALE' END AS event_type,
    'ORD-' || k AS business_ref, CASE WHEN refund THEN 'ORD-' || (k - 1) END AS original_ref,
    'MER-' || lpad(CAST(CASE WHEN k % 199 = 9 THEN (nation + 1) % 25 ELSE nation END AS VARCHAR), 2, '0')
      AS merchant_account,
    ['SGD', 'USD', 'EUR'][region % 3 + 1] AS currency, amount AS gross_minor, day AS event_date, k
  FROM base WHERE k % 89 <> 5
  UNION ALL
  SELECT 'L-S' || c || '-' || scene || n, type, 'SC' || c || '-' || scene || n, NULL, 'MER-S' || c, 'SGD',
    CAST(gross AS BIGINT), CAST(SCENE_DAY + day AS DATE), -c FROM booked),
psp0 AS (
  SELECT *, CAST(amount - CASE WHEN NOT refund AND k % 101 = 11 THEN 50 ELSE 0 END AS BIGINT) AS gross,
    CAST(day + CAST(CASE WHEN k % 83 = 7 THEN 5 ELSE k % 3 END AS INTEGER) AS DATE) AS created
  FROM base WHERE k % 97 <> 3),
psp1 AS (
  SELECT *, CAST(CASE WHEN refund THEN 0 ELSE (gross * 29 + 500) // 1000 + 30 END AS BIGINT) AS fee,
    CAST(created + CAST(1 + k % 2 AS INTEGER) AS DATE) AS available FROM psp0),
psp2 AS (
  SELECT *, CASE WHEN k % 61 <> 13
    THEN CAST(available + CAST((7 - dayofweek(available)) % 7 AS INTEGER) AS DATE) END AS settled FROM psp1),
all_psp AS (
  SELECT 'P-' || k AS record_id, CASE WHEN refund THEN 'refund' ELSE 'charge' END AS type, 'ORD-' || k AS business_ref,
    'MER-' || lpad(CAST(nation AS VARCHAR), 2, '0') AS merchant_account,
    ['SGD', 'USD', 'EUR'][(region + CASE WHEN k % 211 = 9 THEN 1 ELSE 0 END) % 3 + 1] AS currency,
    gross AS gross_minor, fee AS fee_minor, gross - fee AS net_minor, created AS created_date,
    available AS available_on,
    CASE WHEN settled IS NOT NULL THEN 'STL-MER-' || lpad(CAST(nation AS VARCHAR), 2, '0') || '-' ||
      strftime(settled, '%Y%m%d') || CASE WHEN k % 4 < 2 THEN '-A' ELSE '-B' END END AS batch_id,
    settled AS settlement_date,
    CASE WHEN settled IS NOT NULL THEN 'BANK-' || lpad(CAST(nation AS VARCHAR), 2, '0') END AS bank_account,
    CAST(nation AS BIGINT) AS nation, k
  FROM psp2
  UNION ALL
  SELECT 'P-S' || c || '-' || scene || batch || n, type,
    CASE WHEN type <> 'fee' THEN 'SC' || c || '-' || scene ||
      CASE WHEN scene IN (SELECT scene FROM booked) THEN '' ELSE batch END || n END,
    'MER-S' || c, 'SGD', CAST(gross AS BIGINT), CAST(fee AS BIGINT), CAST(gross - fee AS BIGINT),
    CAST(SCENE_DAY + day - 2 AS DATE), CAST(SCENE_DAY + day - 1 AS DATE),
    CASE WHEN batch <> '' THEN 'STL-S' || c || '-' || batch END, CASE WHEN batch <> '' THEN CAST(SCENE_DAY + day AS DATE) END,
    CASE WHEN batch <> '' THEN 'BANK-' || scene || c END, CAST(-1 AS BIGINT), -c
  FROM items),
batch AS (
  SELECT batch_id, min(bank_account) AS account, min(currency) AS currency, max(currency) AS most,
    min(settlement_date) AS day, CAST(sum(net_minor) AS BIGINT) AS net, min(k) AS k, min(nation) AS nation,
    right(batch_id, 1) AS half, left(batch_id, length(batch_id) - 2) AS stem
  FROM all_psp WHERE batch_id IS NOT NULL AND k >= 0 GROUP BY batch_id),
pairs AS (
  SELECT a.stem, a.k % 10 AS how, a.batch_id AS a_id, b.batch_id AS b_id, a.net AS a_net, b.net AS b_net
  FROM batch a JOIN batch b ON a.stem = b.stem AND a.half = 'A' AND b.half = 'B'
  WHERE a.currency = a.most AND b.currency = b.most AND a.currency = b.currency AND a.net > 0 AND b.net > 0
    AND a.k % 10 IN (7, 8, 9)),
labelled AS (
  SELECT batch.*, how, a_id, b_id, a_net, b_net, 'PAYOUT ' || batch_id AS own,
    'PAYOUT ' || a_id || ' ' || b_id AS together, net * 3 // 5 AS part,
    CASE WHEN how = 7 THEN 'merge' WHEN how = 8 THEN 'merge_bare' WHEN how = 9 THEN 'complex'
      WHEN k % 40 = 0 THEN 'none' WHEN net <= 0 THEN 'clean' WHEN k % 40 = 1 THEN 'partial'
      WHEN k % 40 = 2 THEN 'late' WHEN k % 40 = 3 THEN 'split' WHEN k % 40 = 4 THEN 'double'
      WHEN k % 40 = 5 THEN 'elsewhere'
      WHEN k % 40 BETWEEN 6 AND 15 OR (nation % 5 = 0 AND k % 2 = 0) THEN 'bare' ELSE 'clean' END AS label
  FROM batch LEFT JOIN pairs USING (stem)),
payouts AS (
  SELECT batch_id, currency, 1 AS n,
    CASE WHEN label = 'elsewhere' THEN 'BANK-' || lpad(CAST((nation + 1) % 25 AS VARCHAR), 2, '0') ELSE account END
      AS account,
    CASE WHEN label IN ('merge', 'merge_bare') THEN a_net + b_net WHEN label = 'complex' THEN a_net
      WHEN label IN ('partial', 'split') THEN part ELSE net END AS amount,
    CASE WHEN label = 'late' THEN day + 5 WHEN label = 'bare' THEN day + CAST(k % 4 AS INTEGER) ELSE day END AS value,
    CASE WHEN label IN ('merge', 'complex') THEN together WHEN label IN ('merge_bare', 'bare') THEN 'INCOMING PAYMENT'
      ELSE own END AS ref
  FROM labelled WHERE label <> 'none' AND NOT (label IN ('merge', 'merge_bare', 'complex') AND half = 'B')
  UNION ALL
  SELECT batch_id, currency, 2, account,
    CASE label WHEN 'complex' THEN b_net WHEN 'split' THEN net - part ELSE net END,
    CASE label WHEN 'complex' THEN day WHEN 'split' THEN day + 1 ELSE day + 6 END,
    CASE label WHEN 'complex' THEN together ELSE own END
  FROM labelled WHERE label IN ('split', 'double') OR (label = 'complex' AND half = 'A')),
all_bank AS (
  SELECT 'B-' || substring(batch_id, 5) || '-' || n AS record_id, account AS bank_account, currency,
    CAST(amount AS BIGINT) AS amount_minor, CAST(value AS DATE) AS value_date, ref AS reference
  FROM payouts WHERE amount <> 0
  UNION ALL
  SELECT 'B-CASE-S-' || lpad(CAST(c AS VARCHAR), 8, '0') || '-' || scene || line, 'BANK-' || scene || c, currency,
    CAST(amount AS BIGINT), CAST(SCENE_DAY + day AS DATE), array_to_string(list_transform(
      list_filter(string_split_regex(names, '[ ,]'), lambda x: x <> ''), lambda x: 'stl-S' || c || '-' || x), ',')
  FROM lines),
blocked AS (
  SELECT 'ledger' AS source, record_id, k AS issue FROM all_ledger WHERE k >= 0 AND k % 197 = 8
  UNION ALL SELECT 'psp', record_id, k FROM all_psp WHERE k >= 0 AND k % 227 = 10
  UNION ALL SELECT 'psp', 'P-S' || c || '-' || scene || batch || n, c FROM items WHERE conflict
  UNION ALL SELECT 'bank', 'B-CASE-S-' || lpad(CAST(c AS VARCHAR), 8, '0') || '-' || scene || line, c FROM lines WHERE conflict)
""".replace("SCENE_DAY", f"DATE '{views.SCENE_DAY}'")

ENGINE = """
{p}ledger AS (SELECT * FROM all_ledger WHERE event_date <= DATE '{day}'),
{p}psp AS (
  SELECT * REPLACE (CASE WHEN settlement_date <= DATE '{day}' THEN batch_id END AS batch_id,
    CASE WHEN settlement_date <= DATE '{day}' THEN settlement_date END AS settlement_date)
  FROM all_psp WHERE created_date <= DATE '{day}'),
{p}bank AS (SELECT * FROM all_bank WHERE value_date <= DATE '{day}'),
{p}a AS (
  SELECT merchant_account, business_ref, l.record_id AS l_id, p.record_id AS p_id, l.currency AS l_cur,
    p.currency AS p_cur, l.gross_minor AS l_gross, p.gross_minor AS p_gross,
    coalesce(l.event_date, p.created_date) AS anchor_date,
    CASE
      WHEN EXISTS (SELECT 1 FROM blocked b WHERE (source = 'ledger' AND b.record_id = l.record_id)
        OR (source = 'psp' AND b.record_id = p.record_id)) THEN 'SOURCE_CONFLICT'
      WHEN l.record_id IS NOT NULL AND p.record_id IS NOT NULL THEN CASE
        WHEN l.currency <> p.currency THEN 'CURRENCY_MISMATCH'
        WHEN (l.event_type = 'SALE') <> (p.type = 'charge') THEN 'TYPE_MISMATCH'
        WHEN l.gross_minor <> p.gross_minor THEN 'AMOUNT_MISMATCH'
        WHEN abs(l.event_date - p.created_date) > 2 THEN 'DATE_OUT_OF_TOLERANCE' ELSE 'MATCHED' END
      WHEN p.record_id IS NULL AND business_ref IN (SELECT business_ref FROM {p}psp WHERE type <> 'fee') THEN 'ACCOUNT_MISMATCH'
      WHEN l.record_id IS NULL AND business_ref IN (SELECT business_ref FROM {p}ledger) THEN 'ACCOUNT_MISMATCH'
      WHEN DATE '{day}' - coalesce(l.event_date, p.created_date) <= 2 THEN 'PENDING'
      WHEN p.record_id IS NULL THEN 'MISSING_IN_PSP' ELSE 'MISSING_IN_LEDGER' END AS status
  FROM {p}ledger l FULL JOIN (SELECT * FROM {p}psp WHERE type <> 'fee') p USING (merchant_account, business_ref)),
{p}stl AS (
  SELECT batch_id, arg_min(bank_account, record_id) AS bank_account, arg_min(currency, record_id) AS currency,
    arg_min(settlement_date, record_id) AS settlement_date,
    CAST(CASE WHEN count(DISTINCT currency) > 1 THEN 0 ELSE sum(gross_minor) END AS BIGINT) AS gross,
    CAST(CASE WHEN count(DISTINCT currency) > 1 THEN 0 ELSE sum(fee_minor) END AS BIGINT) AS fee,
    CAST(CASE WHEN count(DISTINCT currency) > 1 THEN 0 ELSE sum(net_minor) END AS BIGINT) AS net, count(*) AS items,
    CASE WHEN count(DISTINCT currency) > 1 OR count(DISTINCT bank_account) > 1 OR count(DISTINCT settlement_date) > 1
      OR count(DISTINCT merchant_account) > 1 THEN 'BATCH_INCONSISTENT'
      WHEN bool_or(record_id IN (SELECT record_id FROM blocked WHERE source = 'psp')) THEN 'SOURCE_CONFLICT' ELSE '' END AS problem
  FROM {p}psp WHERE batch_id IS NOT NULL GROUP BY batch_id),
{p}free AS (SELECT * FROM {p}bank WHERE record_id NOT IN (SELECT record_id FROM blocked WHERE source = 'bank')),
{p}stopped AS (SELECT * FROM {p}bank WHERE record_id IN (SELECT record_id FROM blocked WHERE source = 'bank')),
{p}tokens AS (
  SELECT DISTINCT record_id AS bank_id, unnest(string_split_regex(upper(reference), '[\\s,;/|]+')) AS token FROM {p}free),
{p}links AS (SELECT DISTINCT bank_id, batch_id FROM {p}tokens JOIN {p}stl ON token = upper(batch_id)),
{p}held AS (
  SELECT bank_id, min(batch_id) AS batch_id FROM {p}links JOIN {p}stl USING (batch_id) WHERE problem <> '' GROUP BY 1),
{p}edges AS (
  SELECT 'S:' || batch_id AS a, 'K:' || bank_id AS b, batch_id, bank_id FROM {p}links JOIN {p}stl USING (batch_id)
  WHERE problem = '' AND bank_id NOT IN (SELECT bank_id FROM {p}held)),
{p}reach AS (
  SELECT a, a AS z FROM {p}edges
  UNION
  SELECT r.a, e2.a FROM {p}reach r JOIN {p}edges e1 ON r.z = e1.a JOIN {p}edges e2 ON e1.b = e2.b),
{p}comp AS (SELECT a, min(z) AS comp FROM {p}reach GROUP BY a),
{p}linked AS (
  SELECT comp, e.batch_id, e.bank_id, s.net, s.settlement_date, s.currency AS s_cur, s.bank_account AS s_acc,
    k.amount_minor AS amount, k.value_date, k.currency AS k_cur, k.bank_account AS k_acc,
    k.value_date - s.settlement_date BETWEEN -1 AND 3 AS inside
  FROM {p}edges e JOIN {p}comp USING (a) JOIN {p}stl s USING (batch_id) JOIN {p}bank k ON k.record_id = e.bank_id),
{p}s_of AS (SELECT DISTINCT comp, batch_id, net, settlement_date, s_cur, s_acc FROM {p}linked),
{p}k_of AS (SELECT DISTINCT comp, bank_id, amount, value_date, k_cur, k_acc FROM {p}linked),
{p}subsets AS (
  SELECT comp, bank_id AS last, 1 AS n, amount AS total FROM {p}linked WHERE inside AND amount <> net
  UNION ALL
  SELECT x.comp, l.bank_id, x.n + 1, x.total + l.amount FROM {p}subsets x JOIN {p}linked l ON x.comp = l.comp
    AND l.bank_id > x.last WHERE l.inside AND l.amount <> l.net AND x.n < 10),
{p}shape AS (
  SELECT *, CASE
    WHEN places > 1 THEN 'cross'
    WHEN n_s = 1 AND exact = 1 AND EXISTS (SELECT 1 FROM {p}subsets x WHERE x.comp = c.comp AND n > 1 AND x.total = net)
      THEN 'competing'
    WHEN n_s = 1 AND exact = 1 THEN 'b1'
    WHEN n_s = 1 AND exact > 1 THEN 'several'
    WHEN n_s = 1 AND net = total AND all_in AND n_k BETWEEN 2 AND 10 THEN 'split'
    WHEN n_s = 1 AND net = total AND NOT all_in THEN 'date'
    WHEN n_s = 1 AND same_sign AND abs(total) < abs(net) THEN 'partial'
    WHEN n_s = 1 THEN 'amount'
    WHEN n_k = 1 AND net = total AND all_in AND n_s <= 10 THEN 'merged'
    WHEN n_k = 1 THEN 'group' ELSE 'complex' END AS verdict
  FROM (
    SELECT comp, (SELECT count(*) FROM {p}s_of s WHERE s.comp = l.comp) AS n_s,
      (SELECT CAST(sum(net) AS BIGINT) FROM {p}s_of s WHERE s.comp = l.comp) AS net,
      (SELECT count(*) FROM {p}k_of k WHERE k.comp = l.comp) AS n_k,
      (SELECT CAST(sum(amount) AS BIGINT) FROM {p}k_of k WHERE k.comp = l.comp) AS total,
      (SELECT count(*) FROM (SELECT s_acc, s_cur FROM {p}s_of s WHERE s.comp = l.comp
        UNION SELECT k_acc, k_cur FROM {p}k_of k WHERE k.comp = l.comp)) AS places,
      count(*) FILTER (inside AND amount = l.net) AS exact, bool_and(inside) AS all_in,
      bool_and((amount > 0) = (l.net > 0)) AS same_sign, min(batch_id) AS first_batch
    FROM {p}linked l GROUP BY comp) c),
{p}ref_fail AS (
  SELECT s.batch_id, s.s_cur AS currency, s.net, s.settlement_date,
    CASE WHEN verdict = 'cross' THEN CASE WHEN EXISTS (SELECT 1 FROM {p}k_of k WHERE k.comp = s.comp
        AND k.k_cur <> s.s_cur) THEN 'CURRENCY_MISMATCH' ELSE 'ACCOUNT_MISMATCH' END
      WHEN verdict IN ('competing', 'several') THEN 'AMBIGUOUS_CANDIDATES' WHEN verdict = 'date' THEN 'DATE_OUT_OF_WINDOW'
      WHEN verdict = 'partial' THEN 'PARTIAL_RECEIPT' WHEN verdict = 'complex' THEN 'COMPLEX_REFERENCE'
      WHEN verdict = 'group' AND h.net = total THEN 'DATE_OUT_OF_WINDOW' ELSE 'AMOUNT_MISMATCH' END AS status,
    CASE verdict WHEN 'cross' THEN 'B-X7_ACCOUNT_OR_CURRENCY' WHEN 'competing' THEN 'B-X4_AMBIGUOUS'
      WHEN 'several' THEN 'B-X4_AMBIGUOUS' WHEN 'date' THEN 'B-X9_DATE' WHEN 'partial' THEN 'B-X10_PARTIAL'
      WHEN 'complex' THEN 'B-X13_COMPLEX' WHEN 'group' THEN 'B-X12_REF_GROUP' ELSE 'B-X11_REF_AMOUNT' END AS rule,
    CASE WHEN verdict IN ('partial', 'amount') THEN s.net - total WHEN verdict = 'group' THEN h.net - total ELSE s.net END
      AS amount, comp, verdict
  FROM {p}shape h JOIN {p}s_of s USING (comp) WHERE verdict NOT IN ('b1', 'split', 'merged')),
{p}matched_k AS (
  SELECT k.*, verdict FROM {p}shape h JOIN {p}k_of k USING (comp) WHERE verdict IN ('split', 'merged')
    OR (verdict = 'b1' AND bank_id IN (SELECT bank_id FROM {p}linked WHERE inside AND amount = net))),
{p}doubles AS (
  SELECT k.* FROM {p}shape h JOIN {p}k_of k USING (comp)
  WHERE verdict = 'b1' AND bank_id NOT IN (SELECT bank_id FROM {p}matched_k)),
{p}s3 AS (
  SELECT * FROM {p}stl WHERE problem = '' AND batch_id NOT IN (SELECT batch_id FROM {p}s_of)),
{p}k3 AS (
  SELECT * FROM {p}free WHERE record_id NOT IN (SELECT bank_id FROM {p}k_of)
    AND record_id NOT IN (SELECT bank_id FROM {p}held)),
{p}cand AS (
  SELECT *, count(*) OVER (PARTITION BY batch_id) AS ds, count(*) OVER (PARTITION BY record_id) AS dk
  FROM {p}s3 s JOIN {p}k3 k ON s.bank_account = k.bank_account AND s.currency = k.currency AND net = amount_minor
    AND value_date - settlement_date BETWEEN -1 AND 3),
{p}s4 AS (SELECT * FROM {p}s3 WHERE batch_id NOT IN (SELECT batch_id FROM {p}cand)),
{p}k4 AS (SELECT * FROM {p}k3 WHERE record_id NOT IN (SELECT record_id FROM {p}cand)),
{p}near AS (
  SELECT 0 AS shape, record_id AS whole, batch_id AS part, net AS value, amount_minor AS target
  FROM {p}k4 k JOIN {p}s4 s ON s.bank_account = k.bank_account AND s.currency = k.currency
    AND value_date - settlement_date BETWEEN -1 AND 3 AND (net > 0) = (amount_minor > 0) AND abs(net) < abs(amount_minor)
  UNION ALL
  SELECT 1, batch_id, record_id, amount_minor, net
  FROM {p}k4 k JOIN {p}s4 s ON s.bank_account = k.bank_account AND s.currency = k.currency
    AND value_date - settlement_date BETWEEN -1 AND 3 AND (net > 0) = (amount_minor > 0) AND abs(amount_minor) < abs(net)),
{p}few AS (SELECT * FROM {p}near QUALIFY count(*) OVER (PARTITION BY shape, whole) <= 12),
{p}combos AS (
  SELECT shape, whole, target, [part] AS parts, value AS total FROM {p}few
  UNION ALL
  SELECT c.shape, c.whole, c.target, list_append(c.parts, f.part), c.total + f.value FROM {p}combos c
    JOIN {p}few f ON f.shape = c.shape AND f.whole = c.whole AND f.part > c.parts[-1] WHERE len(c.parts) < 4),
{p}sugg AS (
  SELECT *, row_number() OVER (ORDER BY shape, whole, len(parts), parts) AS place,
    CASE shape WHEN 0 THEN parts ELSE [whole] END AS batches, CASE shape WHEN 0 THEN [whole] ELSE parts END AS lines
  FROM {p}combos WHERE len(parts) > 1 AND total = target),
{p}used AS (
  SELECT 'S' AS side, unnest(batches) AS id, place FROM {p}sugg UNION ALL SELECT 'K', unnest(lines), place FROM {p}sugg),
{p}uses AS (SELECT side, id, count(*) AS uses, min(place) AS place FROM {p}used GROUP BY side, id),
{p}contested AS (
  SELECT u.place, max(uses) > 1 AS contested FROM {p}used u JOIN {p}uses USING (side, id) GROUP BY u.place),
{p}told AS (
  SELECT s.*, CASE WHEN contested THEN 'AMBIGUOUS_CANDIDATES' ELSE 'SUGGESTED_GROUP' END AS status
  FROM {p}uses u JOIN {p}contested c USING (place) JOIN {p}s4 s ON s.batch_id = u.id WHERE side = 'S'),
{p}s6 AS (SELECT * FROM {p}s4 WHERE batch_id NOT IN (SELECT batch_id FROM {p}told)),
{p}k6 AS (SELECT * FROM {p}k4 WHERE record_id NOT IN (SELECT id FROM {p}uses WHERE side = 'K')),
{p}states AS (
  SELECT 'A' AS chain, 'ledger' AS record_type, l_id AS record_id, status, l_cur AS currency, l_gross AS amount_minor,
    {a_rule} AS rule FROM {p}a WHERE l_id IS NOT NULL
  UNION ALL SELECT 'A', 'psp', p_id, status, p_cur, p_gross, {a_rule} FROM {p}a WHERE p_id IS NOT NULL
  UNION ALL SELECT 'A', 'psp', record_id, 'OUT_OF_SCOPE', currency, gross_minor, 'A0_FEE_ROW' FROM {p}psp WHERE type = 'fee'
  UNION ALL SELECT 'B', 'bank', record_id, 'SOURCE_CONFLICT', currency, amount_minor, 'B-X2_CONFLICT' FROM {p}stopped
  UNION ALL SELECT 'B', 'psp', record_id,
    CASE WHEN DATE '{day}' - available_on <= 2 THEN 'NOT_DUE' ELSE 'UNSETTLED_OVERDUE' END, currency, net_minor,
    CASE WHEN DATE '{day}' - available_on <= 2 THEN 'B-T1_NOT_DUE' ELSE 'B-X1_UNSETTLED' END
    FROM {p}psp WHERE batch_id IS NULL
  UNION ALL SELECT 'B', 'settlement', batch_id, problem, currency, net, 'B-X3_BATCH_PROBLEM' FROM {p}stl WHERE problem <> ''
  UNION ALL SELECT 'B', 'bank', record_id, 'HELD_FOR_REVIEW', currency, amount_minor, 'B-X3_BATCH_PROBLEM'
    FROM {p}bank WHERE record_id IN (SELECT bank_id FROM {p}held)
  UNION ALL SELECT 'B', 'settlement', batch_id, status, currency, net, rule FROM {p}ref_fail
  UNION ALL SELECT 'B', 'bank', bank_id, CASE WHEN rule = 'B-X4_AMBIGUOUS' THEN 'AMBIGUOUS' ELSE 'HELD_FOR_REVIEW' END,
    k_cur, amount, rule FROM {p}k_of k JOIN (SELECT DISTINCT comp, rule FROM {p}ref_fail) USING (comp)
  UNION ALL SELECT 'B', 'settlement', batch_id, 'MATCHED', s_cur, s.net, {b_rule}
    FROM {p}s_of s JOIN {p}shape USING (comp) WHERE verdict IN ('b1', 'split', 'merged')
  UNION ALL SELECT 'B', 'bank', bank_id, 'MATCHED', k_cur, amount, {b_rule} FROM {p}matched_k
  UNION ALL SELECT 'B', 'bank', bank_id, 'DUPLICATE_REFERENCE_CREDIT', k_cur, amount, 'B-X8_DUP_REF' FROM {p}doubles
  UNION ALL SELECT DISTINCT 'B', 'settlement', batch_id, CASE WHEN ds = 1 AND dk = 1 THEN 'MATCHED'
    ELSE 'AMBIGUOUS_CANDIDATES' END, currency, net, CASE WHEN ds = 1 AND dk = 1 THEN 'B3_AMOUNT_DATE_UNIQUE'
    ELSE 'B-X4_AMBIGUOUS' END FROM {p}cand
  UNION ALL SELECT DISTINCT 'B', 'bank', record_id, CASE WHEN ds = 1 AND dk = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END,
    currency, amount_minor, CASE WHEN ds = 1 AND dk = 1 THEN 'B3_AMOUNT_DATE_UNIQUE' ELSE 'B-X4_AMBIGUOUS' END
    FROM {p}cand
  UNION ALL SELECT 'B', 'settlement', batch_id, status, currency, net, 'B4_AMOUNT_GROUP_SUGGESTION' FROM {p}told
  UNION ALL SELECT 'B', 'bank', record_id, 'SUGGESTED', currency, amount_minor, 'B4_AMOUNT_GROUP_SUGGESTION'
    FROM {p}k4 WHERE record_id IN (SELECT id FROM {p}uses WHERE side = 'K')
  UNION ALL SELECT 'B', 'settlement', batch_id,
    CASE WHEN DATE '{day}' - settlement_date <= 3 THEN 'IN_TRANSIT' ELSE 'MISSING_IN_BANK' END, currency, net,
    CASE WHEN DATE '{day}' - settlement_date <= 3 THEN 'B-T2_IN_TRANSIT' ELSE 'B-X5_NO_BANK' END FROM {p}s6
  UNION ALL SELECT 'B', 'bank', record_id,
    CASE WHEN amount_minor > 0 THEN 'UNEXPECTED_BANK_CREDIT' ELSE 'UNEXPECTED_BANK_DEBIT' END, currency, amount_minor,
    'B-X6_NO_SETTLEMENT' FROM {p}k6),
{p}exceptions AS (
  SELECT 'A' AS chain, 'A|' || merchant_account || '|' || business_ref AS case_key, status AS case_type,
    {a_rule} AS rule, coalesce(l_cur, p_cur) AS currency,
    CASE WHEN status = 'SOURCE_CONFLICT' THEN coalesce(l_gross, p_gross)
      WHEN status = 'AMOUNT_MISMATCH' THEN l_gross - p_gross WHEN l_id IS NOT NULL THEN l_gross ELSE -p_gross END
      AS amount_minor, anchor_date
  FROM {p}a WHERE status NOT IN ('MATCHED', 'PENDING')
  UNION ALL SELECT 'B', 'B|ITEM|' || record_id, 'UNSETTLED_OVERDUE', 'B-X1_UNSETTLED', currency, net_minor, available_on
    FROM {p}psp WHERE batch_id IS NULL AND DATE '{day}' - available_on > 2
  UNION ALL SELECT 'B', 'B|BANK|' || record_id, 'SOURCE_CONFLICT', 'B-X2_CONFLICT', currency, amount_minor, value_date FROM {p}stopped
  UNION ALL SELECT 'B', 'B|STL|' || batch_id, problem, 'B-X3_BATCH_PROBLEM', currency, net, settlement_date
    FROM {p}stl WHERE problem <> ''
  UNION ALL SELECT 'B', 'B|STL|' || batch_id, status, rule, currency, amount, settlement_date FROM {p}ref_fail
  UNION ALL SELECT 'B', 'B|BANK|' || bank_id, 'DUPLICATE_REFERENCE_CREDIT', 'B-X8_DUP_REF', k_cur, amount, value_date
    FROM {p}doubles
  UNION ALL SELECT DISTINCT 'B', 'B|STL|' || batch_id, 'AMBIGUOUS_CANDIDATES', 'B-X4_AMBIGUOUS', currency, net,
    settlement_date FROM {p}cand WHERE NOT (ds = 1 AND dk = 1)
  UNION ALL SELECT 'B', 'B|STL|' || batch_id, status, 'B4_AMOUNT_GROUP_SUGGESTION', currency, net, settlement_date
    FROM {p}told
  UNION ALL SELECT 'B', 'B|STL|' || batch_id, 'MISSING_IN_BANK', 'B-X5_NO_BANK', currency, net, settlement_date
    FROM {p}s6 WHERE DATE '{day}' - settlement_date > 3
  UNION ALL SELECT 'B', 'B|BANK|' || record_id,
    CASE WHEN amount_minor > 0 THEN 'UNEXPECTED_BANK_CREDIT' ELSE 'UNEXPECTED_BANK_DEBIT' END, 'B-X6_NO_SETTLEMENT',
    currency, amount_minor, value_date FROM {p}k6),
{p}groups0 AS (
  SELECT 'A' AS chain, 'A1_EXACT_REF' AS rule, l_cur AS currency, 0 AS phase, [merchant_account, business_ref] AS k1,
    CAST([] AS VARCHAR[]) AS k2, [l_id] AS l, [p_id] AS r, l_gross AS left_total FROM {p}a WHERE status = 'MATCHED'
  UNION ALL
  SELECT 'B', {b_rule}, (SELECT min(s_cur) FROM {p}s_of s WHERE s.comp = h.comp), 1,
    (SELECT list(batch_id ORDER BY batch_id) FROM {p}s_of s WHERE s.comp = h.comp),
    (SELECT list(bank_id ORDER BY bank_id) FROM {p}k_of k WHERE k.comp = h.comp),
    (SELECT list(batch_id ORDER BY batch_id) FROM {p}s_of s WHERE s.comp = h.comp),
    (SELECT list(bank_id ORDER BY bank_id) FROM {p}matched_k k WHERE k.comp = h.comp), net
  FROM {p}shape h WHERE verdict IN ('b1', 'split', 'merged')
  UNION ALL
  SELECT 'B', 'B3_AMOUNT_DATE_UNIQUE', currency, 2, [record_id], [batch_id], [batch_id], [record_id], net
  FROM {p}cand WHERE ds = 1 AND dk = 1),
{p}groups AS (
  SELECT *, chain || '-' || lpad(CAST(row_number() OVER (PARTITION BY chain ORDER BY phase, k1, k2) AS VARCHAR), 6, '0')
    AS group_id FROM {p}groups0),
{p}members AS (
  SELECT group_id, rule, currency, left_total, 'L' AS side, unnest(l) AS record_id FROM {p}groups
  UNION ALL SELECT group_id, rule, currency, left_total, 'R', unnest(r) FROM {p}groups)
"""

_A_RULE = (
    "CASE status WHEN 'SOURCE_CONFLICT' THEN 'A-X1_CONFLICT' WHEN 'CURRENCY_MISMATCH' THEN 'A-X3_CURRENCY' WHEN 'TYPE_MISMATCH' THEN 'A-X4_TYPE' "
    "WHEN 'AMOUNT_MISMATCH' THEN 'A-X5_AMOUNT' WHEN 'DATE_OUT_OF_TOLERANCE' THEN 'A-X6_DATE' "
    "WHEN 'MATCHED' THEN 'A1_EXACT_REF' WHEN 'ACCOUNT_MISMATCH' THEN 'A-X2_ACCOUNT' WHEN 'PENDING' THEN 'A-T1_GRACE' "
    "WHEN 'MISSING_IN_PSP' THEN 'A-X7_NO_PSP' ELSE 'A-X8_NO_LEDGER' END"
)
_B_RULE = "CASE verdict WHEN 'b1' THEN 'B1_REF_1TO1' WHEN 'split' THEN 'B2S_REF_SPLIT' ELSE 'B2M_REF_MERGED' END"

RAW = """
raw_ledger AS (
  SELECT k, 0 AS copy, record_id, event_type, currency, merchant_account, business_ref, event_date, gross_minor, '' AS note
  FROM all_ledger WHERE k >= 0
  UNION ALL
  SELECT k, 1, record_id, event_type, currency, merchant_account, business_ref, event_date,
    gross_minor + CASE WHEN k % 197 = 8 THEN 1 ELSE 0 END, CASE WHEN k % 211 = 12 THEN 'again' ELSE '' END
  FROM all_ledger WHERE k >= 0 AND (k % 193 = 7 OR k % 197 = 8 OR k % 211 = 12)
  UNION ALL
  SELECT k, 2, record_id || '-B', event_type, currency, merchant_account, business_ref, event_date, gross_minor, ''
  FROM all_ledger WHERE k >= 0 AND k % 223 = 11),
checked AS (
  SELECT *, CASE WHEN k % 181 = 5 THEN 'UNSUPPORTED_CURRENCY'
    WHEN k % 173 IN (1, 2, 3) AND NOT (copy = 1 AND k % 197 = 8) THEN 'BAD_AMOUNT'
    WHEN (event_type = 'SALE') = (gross_minor <= 0) OR (k % 229 = 13 AND NOT (copy = 1 AND k % 197 = 8)) THEN 'SIGN_RULE'
    WHEN k % 191 = 6 THEN 'BAD_IDENTIFIER' WHEN k % 179 = 4 THEN 'BAD_DATE' ELSE '' END AS reason
  FROM raw_ledger),
verdicts AS (
  SELECT *, k * 4 + copy AS ord, first_value(gross_minor) OVER w AS first_gross, first_value(note) OVER w AS first_note,
    first_value(k * 4 + copy) OVER w AS first_ord,
    CASE WHEN copy = 2 THEN (SELECT min(f.k * 4 + f.copy) FROM checked f WHERE f.reason = '' AND f.copy < 2
      AND f.k = checked.k) END AS key_ord
  FROM checked WHERE reason = '' WINDOW w AS (PARTITION BY record_id ORDER BY copy)),
judged AS (
  SELECT record_id, ord, CASE WHEN ord <> first_ord THEN CASE WHEN (gross_minor, note) = (first_gross, first_note)
      THEN 'DUPLICATE_ROW' ELSE 'CONFLICT_RECORD_ID' END WHEN key_ord IS NOT NULL THEN 'CONFLICT_BUSINESS_KEY' ELSE 'LOADED' END
    AS verdict, CASE WHEN ord <> first_ord THEN first_ord ELSE key_ord END AS conflicts_with FROM verdicts)
"""


def _with(select: str, *days: tuple[str, date], raw: bool = False) -> str:
    parts = [VIEWS.strip()] + ([RAW.strip()] if raw else [])
    for p, day in days:
        parts.append(ENGINE.strip().replace("{a_rule}", _A_RULE).replace("{b_rule}", _B_RULE).replace("{p}", p).replace("{day}", day.isoformat()))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.replace("{day}", views.AS_OF.isoformat())


def _plain(minor: str) -> str:
    return f"CAST(CAST({minor} AS DECIMAL(20, 0)) * CAST(0.01 AS DECIMAL(3, 2)) AS VARCHAR)"


_EVIDENCE = """
SELECT DISTINCT case_key, record_type, record_id, role, CAST(members AS BIGINT) AS members FROM (
  SELECT 'A|' || merchant_account || '|' || business_ref AS case_key, 'ledger' AS record_type, l_id AS record_id, 'ledger' AS role, 1 AS members
    FROM r_a WHERE status NOT IN ('MATCHED', 'PENDING') AND l_id IS NOT NULL
  UNION ALL SELECT 'A|' || merchant_account || '|' || business_ref, 'psp', p_id, 'psp', 1
    FROM r_a WHERE status NOT IN ('MATCHED', 'PENDING') AND p_id IS NOT NULL
  UNION ALL SELECT 'A|' || merchant_account || '|' || business_ref, 'row_issue', CAST(issue AS VARCHAR), 'conflicting_row', 1
    FROM r_a JOIN blocked b ON (source = 'ledger' AND b.record_id = l_id) OR (source = 'psp' AND b.record_id = p_id) WHERE status = 'SOURCE_CONFLICT'
  UNION ALL SELECT 'B|ITEM|' || record_id, 'psp', record_id, 'psp', 1 FROM r_psp WHERE batch_id IS NULL AND DATE '{day}' - available_on > 2
  UNION ALL SELECT 'B|BANK|' || record_id, 'bank', record_id, 'bank', 1 FROM r_stopped
  UNION ALL SELECT 'B|BANK|' || record_id, 'row_issue', CAST(issue AS VARCHAR), 'conflicting_row', 1
    FROM r_stopped JOIN blocked b USING (record_id) WHERE source = 'bank'
  UNION ALL SELECT 'B|STL|' || batch_id, 'bank', bank_id, 'referencing_line', 1 FROM r_links JOIN r_stl USING (batch_id) WHERE problem <> ''
  UNION ALL SELECT 'B|STL|' || f.batch_id, 'bank', bank_id, CASE WHEN verdict IN ('competing', 'several') THEN 'candidate'
      WHEN verdict = 'partial' THEN 'partial_receipt' ELSE 'referencing_line' END, 1
    FROM r_ref_fail f JOIN r_k_of USING (comp) WHERE (SELECT count(*) FROM r_s_of s WHERE s.comp = f.comp) = 1
  UNION ALL SELECT 'B|STL|' || f.batch_id, 'class', 'R|' || min(bank_id), 'referencing_line', count(*)
    FROM r_ref_fail f JOIN r_k_of USING (comp) WHERE (SELECT count(*) FROM r_s_of s WHERE s.comp = f.comp) > 1 GROUP BY f.batch_id
  UNION ALL SELECT 'B|BANK|' || bank_id, 'bank', bank_id, 'bank', 1 FROM r_doubles
  UNION ALL SELECT 'B|BANK|' || bank_id, 'settlement', batch_id, 'referenced', 1 FROM r_doubles JOIN r_s_of USING (comp)
  UNION ALL SELECT 'B|STL|' || batch_id, 'class', 'U|' || bank_account || '|' || currency || '|' || net || '|' || value_date, 'candidate', count(*)
    FROM r_cand WHERE batch_id IN (SELECT batch_id FROM r_cand WHERE NOT (ds = 1 AND dk = 1)) GROUP BY batch_id, bank_account, currency, net, value_date
  UNION ALL SELECT 'B|STL|' || t.batch_id, 'bank', unnest(s.lines), 'suggested_counterpart', 1
    FROM r_told t JOIN r_uses u ON u.side = 'S' AND u.id = t.batch_id JOIN r_sugg s ON s.place = u.place
  UNION ALL SELECT 'B|BANK|' || record_id, 'bank', record_id, 'bank', 1 FROM r_k6
  UNION ALL SELECT case_key, 'settlement', substring(case_key, 7), 'settlement', 1 FROM r_exceptions WHERE case_key LIKE 'B|STL|%'
  UNION ALL SELECT case_key, 'psp', record_id, 'settlement_item', 1 FROM r_exceptions JOIN r_psp ON case_key = 'B|STL|' || batch_id)
"""
_CLASSES = """
SELECT DISTINCT 'R|' || (SELECT min(bank_id) FROM r_k_of m WHERE m.comp = k.comp) AS class_key, 'bank' AS record_type, bank_id AS record_id
FROM r_k_of k WHERE comp IN (SELECT comp FROM r_ref_fail) AND (SELECT count(*) FROM r_s_of s WHERE s.comp = k.comp) > 1
UNION ALL
SELECT DISTINCT 'U|' || bank_account || '|' || currency || '|' || net || '|' || value_date, 'bank', record_id
FROM r_cand WHERE record_id NOT IN (SELECT record_id FROM r_cand WHERE ds = 1 AND dk = 1)
"""
_HISTORY = f"""
, keys AS (
  SELECT case_key, a.case_key IS NOT NULL AS in1, o.case_key IS NOT NULL AS in2, r.case_key IS NOT NULL AS in3,
    coalesce(a.case_key IS NOT NULL AND (TRY_CAST(regexp_extract(case_key, 'STL-S([0-9]+)-', 1) AS INTEGER) // {views.SCENE_EVERY}) % 2 = 0, FALSE) AS by_hand,
    (a.case_type, a.rule, a.amount_minor, a.currency) AS f1, (o.case_type, o.rule, o.amount_minor, o.currency) AS f2,
    (r.case_type, r.rule, r.amount_minor, r.currency) AS f3
  FROM a_exceptions a FULL JOIN o_exceptions o USING (case_key) FULL JOIN r_exceptions r USING (case_key))
"""
_EVENTS = _HISTORY + """
SELECT CAST(2 AS BIGINT) AS run_id, case_key, CASE WHEN NOT in1 THEN 'CASE_OPENED' WHEN in2 THEN 'CASE_ENGINE_FIELDS_UPDATED'
  WHEN by_hand THEN 'CASE_ENGINE_CLEARED' ELSE 'CASE_AUTO_CLEARED' END AS action
FROM keys WHERE (in1 OR in2) AND NOT (in1 AND in2 AND f1 = f2)
UNION ALL
SELECT 3, case_key, CASE WHEN NOT in1 AND NOT in2 THEN 'CASE_OPENED' WHEN in3 AND in2 THEN 'CASE_ENGINE_FIELDS_UPDATED'
  WHEN in3 AND by_hand THEN 'CASE_ISSUE_REAPPEARED' WHEN in3 THEN 'CASE_REOPENED'
  WHEN by_hand THEN 'CASE_ENGINE_CLEARED' ELSE 'CASE_AUTO_CLEARED' END
FROM keys WHERE (in3 OR in2) AND NOT (in2 AND in3 AND f2 = f3)
UNION ALL
SELECT 3, case_key, 'CASE_ENGINE_FIELDS_UPDATED' FROM keys WHERE in1 AND NOT in2 AND in3 AND f1 <> f3
"""
_CASES = _HISTORY + """
SELECT case_key,
  CASE WHEN by_hand THEN 'Resolved' WHEN in3 THEN 'Open' ELSE 'Resolved' END AS status,
  CASE WHEN by_hand THEN 'NO_ACTION_REQUIRED' WHEN in3 THEN '' ELSE 'AUTO_CLEARED' END AS disposition,
  in3 AS engine_active, CAST(CASE WHEN in1 THEN 1 WHEN in2 THEN 2 ELSE 3 END AS BIGINT) AS first_seen_run,
  CAST(CASE WHEN in3 THEN 3 WHEN in2 THEN 2 ELSE 1 END AS BIGINT) AS last_seen_run
FROM keys
"""
_INVARIANTS = """
, of_group AS (
  SELECT m.group_id, side, s.* FROM r_members m JOIN r_states s ON s.record_id = m.record_id AND s.chain = left(m.group_id, 1))
SELECT 'conservation' AS invariant, count(*) AS broken FROM (SELECT group_id FROM of_group GROUP BY group_id HAVING
  coalesce(sum(amount_minor) FILTER (side = 'L'), 0) <> coalesce(sum(amount_minor) FILTER (side = 'R'), 0))
UNION ALL SELECT 'one_currency', count(*) FROM (SELECT group_id FROM of_group GROUP BY group_id HAVING count(DISTINCT currency) > 1)
UNION ALL SELECT 'consumed_once', count(*) FROM (SELECT 1 FROM of_group GROUP BY chain, record_type, record_id HAVING count(*) > 1)
UNION ALL SELECT 'one_state', count(*) FROM (SELECT 1 FROM r_states GROUP BY chain, record_type, record_id HAVING count(*) > 1)
UNION ALL SELECT 'unique_case_key', count(*) FROM (SELECT 1 FROM r_exceptions GROUP BY case_key HAVING count(*) > 1)
"""
_METRICS = """
, auto AS (
  SELECT chain, array_to_string(list_sort(l), ',') || '=' || array_to_string(list_sort(r), ',') AS pair FROM r_groups
  WHERE l[1] NOT LIKE 'L-S%' AND l[1] NOT LIKE 'STL-S%'),
paid AS (
  SELECT p.*, label, a_id, b_id FROM payouts p JOIN labelled l USING (batch_id) WHERE amount <> 0
    AND NOT (label = 'double' AND n = 2) AND label NOT IN ('partial', 'late', 'elsewhere')),
truth AS (
  SELECT 'A' AS chain, 'L-' || k || '=P-' || k AS pair, k % 211 <> 9 AND NOT (k % 101 = 11 AND NOT refund) AND k % 83 <> 7
    AND k % 197 <> 8 AND k % 227 <> 10 AND day + 2 <= DATE '{day}' AS meant
  FROM base WHERE k % 89 <> 5 AND k % 97 <> 3 AND k % 199 <> 9
  UNION ALL
  SELECT 'B', CASE WHEN any_value(label) IN ('merge', 'merge_bare', 'complex') THEN any_value(a_id) || ',' || any_value(b_id) ELSE batch_id END
    || '=' || string_agg('B-' || substring(batch_id, 5) || '-' || n, ',' ORDER BY n), any_value(label) NOT IN ('merge_bare', 'complex')
  FROM paid GROUP BY batch_id)
SELECT chain, count(*) FILTER (a.pair IS NOT NULL) AS matched, count(*) FILTER (a.pair IS NOT NULL AND t.pair IS NULL) AS false_matches,
  count(*) FILTER (meant) AS meant, count(*) FILTER (meant AND a.pair IS NOT NULL) AS found
FROM (SELECT *, pair AS p FROM auto) a FULL JOIN (SELECT *, pair AS p FROM truth) t USING (chain, p) GROUP BY chain
"""


def statements() -> dict[str, str]:
    run, day18 = ("r_", views.AS_OF), views.AS_OF.replace(day=18)
    states = "SELECT record_type, record_id, status, currency, amount_minor, rule FROM r_states WHERE "
    cases = "SELECT case_key, case_type, rule, currency, amount_minor, anchor_date FROM r_exceptions WHERE "
    groups = (
        "SELECT group_id, m.rule, m.currency, left_total, side, m.record_id, s.amount_minor FROM r_members m "
        "JOIN r_states s ON s.record_id = m.record_id AND s.chain = left(m.group_id, 1) WHERE "
    )
    big = lambda x: f"CAST({x} AS BIGINT)"
    sums = f"count(*) AS n, {big('sum(amount_minor)')} AS amount_minor"
    sides = " UNION ALL ".join(
        f"SELECT '{s}' AS source, currency, count(*) AS n, {big(f'sum({c})')} AS amount_minor FROM all_{s} GROUP BY currency"
        for s, c in (("ledger", "gross_minor"), ("psp", "net_minor"), ("bank", "amount_minor"))
    )
    ranges = " UNION ALL ".join(
        f"SELECT '{s}' AS source, count(*) AS n, min({c}) AS first_day, max({c}) AS last_day FROM all_{s}"
        for s, c in (("ledger", "event_date"), ("psp", "created_date"), ("bank", "value_date"))
    )
    day = views.AS_OF.isoformat()
    cut = " UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) FILTER ({what}) AS excluded FROM all_{s}"
        for name, s, what in (
            ("ledger", "ledger", f"event_date > DATE '{day}'"), ("psp", "psp", f"created_date > DATE '{day}'"),
            ("bank", "bank", f"value_date > DATE '{day}'"),
            ("psp_settlement_after_as_of", "psp", f"created_date <= DATE '{day}' AND settlement_date > DATE '{day}'"),
        )
    )
    rollup = (
        "SELECT chain, record_type, currency, count(*) AS total_count, CAST(sum(amount_minor) AS BIGINT) AS total_amount, "
        "count(*) FILTER (status = 'MATCHED') AS matched_count, "
        "CAST(coalesce(sum(amount_minor) FILTER (status = 'MATCHED'), 0) AS BIGINT) AS matched_amount, "
        "count(*) FILTER (status <> 'MATCHED') AS unmatched_count, "
        "CAST(coalesce(sum(amount_minor) FILTER (status <> 'MATCHED'), 0) AS BIGINT) AS unmatched_amount "
        "FROM r_states GROUP BY chain, record_type, currency"
    )
    bridge = (
        "SELECT currency, count(*) AS batches, CAST(sum(gross) AS BIGINT) AS gross_minor, CAST(sum(fee) AS BIGINT) AS fee_minor, "
        "CAST(sum(net) AS BIGINT) AS net_minor FROM r_stl WHERE problem <> 'BATCH_INCONSISTENT' GROUP BY currency"
    )
    chain = "CASE chain WHEN 'A' THEN 'A (gross)' ELSE 'B (net)' END"
    long = (
        f"SELECT 'chain' AS section, {chain} AS chain, record_type AS source, currency, 'total' AS metric, total_count AS count, {_plain('total_amount')} AS amount FROM ({rollup}) "
        f"UNION ALL SELECT 'chain', {chain}, record_type, currency, 'matched', matched_count, {_plain('matched_amount')} FROM ({rollup}) "
        f"UNION ALL SELECT 'chain', {chain}, record_type, currency, 'status:' || status, count(*), {_plain('sum(amount_minor)')} FROM r_states WHERE status <> 'MATCHED' GROUP BY chain, record_type, currency, status "
        + " ".join(f"UNION ALL SELECT 'settlement_bridge', 'B', 'psp', currency, '{m}', batches, {_plain(f'{m}_minor')} FROM ({bridge})" for m in ("gross", "fee", "net"))
        + f" UNION ALL SELECT 'match_groups', chain, rule, currency, 'groups', count(*), {_plain('sum(left_total)')} FROM r_groups GROUP BY chain, rule, currency "
        f"UNION ALL SELECT 'open_exceptions', chain, case_type, currency, 'open (abs exposure)', count(*), {_plain('sum(abs(amount_minor))')} FROM r_exceptions GROUP BY chain, case_type, currency "
        f"UNION ALL SELECT 'as_of_cutoff', '', source, '', 'excluded (dated after as-of)', excluded, '' FROM ({cut})"
    )
    view = _with
    return {
        "ledger_view": view("SELECT * EXCLUDE (k) FROM all_ledger"),
        "psp_view": view("SELECT * EXCLUDE (nation, k) FROM all_psp"),
        "bank_view": view("SELECT * FROM all_bank"),
        "amount_formats": view(
            f"SELECT record_id, {_plain('net_minor')} AS plain, "
            "CASE WHEN net_minor < 0 THEN '-' ELSE '' END || format('{:,}', abs(net_minor) // 100) || '.' || "
            "lpad(CAST(abs(net_minor) % 100 AS VARCHAR), 2, '0') AS shown, CAST(abs(net_minor) * 100 + 10 AS BIGINT) AS parsed FROM all_psp"
        ),
        "csv_guard": view(
            "SELECT record_id, CASE k % 5 WHEN 0 THEN '''=' || business_ref WHEN 1 THEN '-' || k WHEN 2 THEN '''@' || type "
            "ELSE merchant_account END AS cell FROM all_psp"
        ),
        "ledger_validate": _with(
            "SELECT k, CAST(copy AS BIGINT) AS copy, reason, CASE WHEN reason = '' THEN gross_minor END AS gross_minor, "
            "CASE WHEN reason = '' THEN event_date END AS event_day FROM checked", raw=True),
        "psp_validate": view(
            "SELECT k, CASE WHEN k % 179 = 4 THEN 'BAD_VALUE' WHEN k % 173 = 1 THEN 'NET_MISMATCH' "
            "WHEN (type = 'charge' AND gross_minor <= 0) OR (type = 'refund' AND gross_minor >= 0) THEN 'SIGN_RULE' "
            "WHEN k % 191 = 6 THEN 'MISSING_VALUE' WHEN k % 193 = 7 AND batch_id IS NOT NULL THEN 'MISSING_VALUE' "
            "WHEN k % 181 = 5 THEN 'BAD_DATE' ELSE '' END AS reason FROM all_psp"
        ),
        "bank_validate": view(
            "SELECT record_id, CASE WHEN n IN (2, 3) THEN 'BAD_AMOUNT' WHEN n = 1 THEN 'MISSING_VALUE' WHEN n = 4 THEN 'MISSING_VALUE' "
            "ELSE '' END AS reason FROM (SELECT record_id, CAST(substring(record_id, 10, 8) AS INTEGER) % 101 AS n FROM all_bank)"
        ),
        "dedupe_rows": _with("SELECT * FROM judged", raw=True),
        "conflict_rows": _with("SELECT j.record_id, j.verdict, j.ord, f.record_id AS stands FROM judged j JOIN judged f "
                               "ON f.ord = j.conflicts_with WHERE j.verdict LIKE 'CONFLICT%'", raw=True),
        "blocked_records": _with("SELECT DISTINCT f.record_id FROM judged j JOIN judged f ON f.ord = j.conflicts_with WHERE j.verdict LIKE 'CONFLICT%'", raw=True),
        "import_control_totals": view(sides),
        "input_ranges": view(ranges),
        "default_as_of": view(
            f"SELECT max(d) AS as_of FROM (SELECT event_date AS d FROM all_ledger UNION ALL SELECT created_date FROM all_psp "
            f"UNION ALL SELECT value_date FROM all_bank WHERE value_date <= DATE '{day}')"
        ),
        "as_of_counts": view(cut),
        "chain_a_status": _with(states + "chain = 'A'", run),
        "chain_a_groups": _with(groups + "m.group_id LIKE 'A%'", run),
        "chain_a_exceptions": _with(cases + "chain = 'A'", run),
        "chain_a_account_mismatch": _with(cases + "chain = 'A' AND case_type = 'ACCOUNT_MISMATCH'", run),
        "settlements": _with("SELECT batch_id, bank_account, currency, settlement_date, gross, fee, net, items, problem FROM r_stl", run),
        "settlement_bridge": _with(bridge, run),
        "unsettled_items": _with(states + "chain = 'B' AND record_type = 'psp'", run),
        "reference_links": _with("SELECT bank_id, batch_id FROM r_links", run),
        "reference_matches": _with(groups + "m.rule LIKE 'B1%' OR m.rule LIKE 'B2%'", run),
        "amount_matches": _with(groups + "m.rule LIKE 'B3%'", run),
        "reference_exceptions": _with(cases + "rule IN ('B-X3_BATCH_PROBLEM', 'B-X7_ACCOUNT_OR_CURRENCY', 'B-X9_DATE', 'B-X10_PARTIAL', 'B-X11_REF_AMOUNT', 'B-X12_REF_GROUP', 'B-X13_COMPLEX')", run),
        "duplicate_credits": _with(cases + "rule = 'B-X8_DUP_REF'", run),
        "ambiguous": _with(cases + "rule = 'B-X4_AMBIGUOUS'", run),
        "group_suggestions": _with(cases + "rule = 'B4_AMOUNT_GROUP_SUGGESTION'", run),
        "leftovers": _with(cases + "rule IN ('B-X5_NO_BANK', 'B-X6_NO_SETTLEMENT')", run),
        "record_status_all": _with(states + "true", run),
        "status_breakdown": _with(f"SELECT chain, record_type, currency, status, {sums} FROM r_states GROUP BY ALL", run),
        "side_rollup": _with(rollup, run),
        "groups_by_rule": _with("SELECT chain, rule, currency, count(*) AS n_groups, CAST(sum(left_total) AS BIGINT) AS amount_minor FROM r_groups GROUP BY ALL", run),
        "exceptions_by_type": _with(f"SELECT chain, case_type, currency, {sums} FROM r_exceptions GROUP BY ALL", run),
        "open_exposure": _with("SELECT chain, case_type, currency, count(*) AS n, CAST(sum(abs(amount_minor)) AS BIGINT) AS exposure_minor FROM r_exceptions GROUP BY ALL", run),
        "overdue_cases": _with(f"SELECT case_key, CAST(DATE '{day}' - anchor_date AS BIGINT) AS age_days FROM r_exceptions WHERE DATE '{day}' - anchor_date > 3", run),
        "run_counts": _with(" UNION ALL ".join(f"SELECT '{w}' AS what, count(*) AS n FROM r_{t}" for w, t in (
            ("groups", "groups"), ("exceptions", "exceptions"), ("ledger", "ledger"), ("psp", "psp"), ("bank", "bank"), ("settlements", "stl"))), run),
        "summary_long": _with(long, run),
        "settlement_problems": _with("SELECT batch_id, problem, items FROM r_stl WHERE problem <> ''", run),
        "component_shapes": _with("SELECT min(batch_id) AS first_batch, count(DISTINCT batch_id) AS n_s, count(DISTINCT bank_id) AS n_k FROM r_linked GROUP BY comp", run),
        "capped_lines": _with("SELECT 'B|BANK|' || record_id AS case_key FROM r_k6 WHERE record_id IN (SELECT whole FROM r_near WHERE shape = 0 GROUP BY whole HAVING count(*) > 12)", run),
        "filter_values": _with("SELECT DISTINCT 'case_type' AS filter, case_type AS value FROM r_exceptions UNION ALL SELECT DISTINCT 'currency', currency FROM r_exceptions", run),
        "evidence_rows": _with(_EVIDENCE, run),
        "evidence_classes": _with(_CLASSES, run),
        "case_sync_diff": _with(
            "SELECT coalesce(n.case_key, o.case_key) AS case_key, CASE WHEN o.case_key IS NULL THEN 'OPEN' WHEN n.case_key IS NULL THEN 'AUTO_CLEAR' "
            "WHEN (n.case_type, n.rule, n.amount_minor, n.currency) <> (o.case_type, o.rule, o.amount_minor, o.currency) THEN 'UPDATE' ELSE 'KEEP' END AS action "
            "FROM r_exceptions n FULL JOIN o_exceptions o ON n.case_key = o.case_key", run, ("o_", views.AS_OF.replace(day=20))),
        "case_events": _with(_EVENTS, ("a_", day18), ("o_", views.AS_OF.replace(day=20)), run),
        "case_states": _with(_CASES, ("a_", day18), ("o_", views.AS_OF.replace(day=20)), run),
        "case_list": _with(
            "SELECT case_key, case_id, row_number() OVER (ORDER BY anchor_date, case_id) AS place FROM (SELECT case_key, chain, anchor_date, "
            "row_number() OVER (ORDER BY case_key) AS case_id FROM r_exceptions) WHERE chain = 'B'", run),
        "run_snapshot": _with(
            "SELECT n.case_key, CASE WHEN o.case_key IS NULL THEN 'Not tracked (historical run)' ELSE 'Open' END AS status, '' AS owner, '' AS disposition "
            "FROM r_exceptions n LEFT JOIN o_exceptions o ON n.case_key = o.case_key", run, ("o_", views.AS_OF.replace(day=20))),
        "invariants": _with(_INVARIANTS, run),
        "eval_metrics": _with(_METRICS, run),
    }
