"""The SQL that checks the engine's queries: shared table expressions, put before a query as it needs them."""

from __future__ import annotations

import re


def _adapter(session: str) -> str:
    return f"""SELECT {session} AS session, ts AS event_time, event_id AS seq, user_id,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS event_type, k AS product_id, k // 10 AS category_id,
    CASE WHEN k % 7 <> 0 THEN 'brand' || CAST(k % 4 AS VARCHAR) END AS brand, value AS price
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


def _prepared(ev: str, until: str = "TRUE") -> str:
    return f"""SELECT session, product_id, event_type, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, seq DESC, product_id, event_type) AS rn
    FROM (SELECT session, product_id, event_type, max(epoch_us(event_time) // 1000000) AS ts, max(seq) AS seq FROM {ev} WHERE {until} GROUP BY ALL)) WHERE rn <= 30"""


def _weights(prepared: str) -> str:
    return f"""SELECT kind, product_id, neighbour, weight FROM (
    SELECT product_id, neighbour, unnest(['time', 'type', 'buy2buy']) AS kind, unnest([
      CASE WHEN n > 0 THEN n + 3.0::DOUBLE * (s - n * t0)::BIGINT / greatest(t1 - t0, 1) END, type_w::DOUBLE, buy_w::DOUBLE]) AS weight
    FROM (SELECT product_id, neighbour, count(time_ts) AS n, sum(time_ts) AS s, sum(type_w) AS type_w, sum(buy_w) AS buy_w FROM (
        SELECT a.session, a.product_id, b.product_id AS neighbour, max(CASE WHEN abs(a.ts - b.ts) < 86400 THEN a.ts END) AS time_ts,
          max(CASE WHEN abs(a.ts - b.ts) < 86400 THEN CASE b.event_type WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 3 END END) AS type_w,
          max(CASE WHEN a.event_type > 0 AND b.event_type > 0 THEN 1 END) AS buy_w
        FROM {prepared} a JOIN {prepared} b ON a.session = b.session AND a.product_id <> b.product_id AND abs(a.ts - b.ts) < 14 * 86400
        GROUP BY ALL) GROUP BY ALL), (SELECT min(ts) AS t0, max(ts) AS t1 FROM {prepared}))
  WHERE weight IS NOT NULL"""


def _matrix(weights: str) -> str:
    return f"""SELECT kind, product_id, neighbour, weight::FLOAT AS weight, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, product_id ORDER BY weight DESC, neighbour) AS rank FROM {weights}) WHERE rank <= 20"""


def _cases(ev: str, start: str, end: str, p: str) -> dict[str, str]:
    """Table expressions <p>_own, <p>_pick, <p>_hist for one window."""
    return {
        f"{p}_sess": f"""SELECT session FROM (SELECT session, min(event_time) AS f, count(DISTINCT product_id) AS k FROM {ev} GROUP BY session)
    WHERE f >= TIMESTAMP '{start}' AND f < TIMESTAMP '{end}' AND k >= 2""",
        f"{p}_runs": f"""SELECT *, sum(head) OVER (PARTITION BY session ORDER BY event_time, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (
    SELECT *, CASE WHEN coalesce(product_id <> lag(product_id) OVER (PARTITION BY session ORDER BY event_time, seq), TRUE) THEN 1 ELSE 0 END AS head,
      row_number() OVER (PARTITION BY session ORDER BY event_time, seq) - 1 AS pos FROM {ev} WHERE session IN (SELECT session FROM {p}_sess))""",
        f"{p}_own": f"""SELECT r.*, h.product_id AS target FROM {p}_runs r LEFT JOIN {p}_runs h ON h.session = r.session AND h.run = r.run + 1 AND h.head = 1""",
        f"{p}_pick": f"""SELECT session, pos AS cut_pos, event_time AS cut_time, product_id AS last_product, target FROM (
    SELECT *, row_number() OVER (PARTITION BY session ORDER BY sha256('0:' || session || ':' || pos), pos) AS u FROM {p}_own WHERE target IS NOT NULL) WHERE u = 1""",
        f"{p}_hist": f"""SELECT o.* FROM {p}_own o JOIN {p}_pick p USING (session) WHERE o.pos <= p.cut_pos""",
        f"{p}_items": f"""SELECT *, row_number() OVER (PARTITION BY session ORDER BY h_pos DESC) - 1 AS h_rank FROM (
    SELECT session, product_id, count(*) AS h_events, max(event_time) AS h_last, max(pos) AS h_pos, max(event_type) AS h_max_type FROM {p}_hist GROUP BY ALL)""",
    }


def _scores(items: str, matrix: str) -> str:
    return f"""SELECT session, kind, product_id, h_rank, r * w AS part FROM (
    SELECT i.session, m.kind, m.neighbour AS product_id, i.h_rank, 1.0::DOUBLE / (1 + h_rank) AS r, m.w::DOUBLE AS w FROM {items} i JOIN
      (SELECT kind, product_id, neighbour, (weight::DOUBLE / max(weight) OVER (PARTITION BY kind, product_id))::FLOAT AS w FROM {matrix}) m USING (product_id))"""


def _top(scores: str, pick: str, pop: str, k: int = 20) -> str:
    return f"""SELECT session, list_concat(own, list_filter(filler, lambda x: x <> last_product AND NOT list_contains(own, x)), list_transform(range({k}), lambda x: -1))[1:{k}] AS run FROM (
    SELECT p.session, p.last_product, coalesce(o.own, []::BIGINT[]) AS own FROM {pick} p LEFT JOIN (
      SELECT session, list(product_id ORDER BY rk) AS own FROM (SELECT s.session, s.product_id, row_number() OVER (PARTITION BY s.session ORDER BY score DESC, s.product_id) AS rk
        FROM {scores} s JOIN {pick} c ON c.session = s.session AND c.last_product <> s.product_id) WHERE rk <= {k} GROUP BY session) o USING (session)),
    (SELECT list(product_id ORDER BY pop DESC, product_id) AS filler FROM (SELECT * FROM {pop} ORDER BY pop DESC, product_id LIMIT {k + 64}))"""


def metrics(runs: str, pick: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count(*) AS n_cases, round(avg(CASE WHEN rk BETWEEN 1 AND 20 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_20, round(avg(CASE WHEN rk BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_10,
    round(avg(CASE WHEN rk BETWEEN 1 AND 10 THEN 1 / log2(rk + 1) ELSE 0 END), 4) AS ndcg_10, round(avg(CASE WHEN rk BETWEEN 1 AND 20 THEN 1.0::DOUBLE / rk ELSE 0 END), 4) AS mrr_20
    FROM (SELECT {keys}coalesce(list_position(run, target), 0) AS rk FROM {runs} JOIN {pick} USING (session)) {'GROUP BY ' + by if by else ''}"""


def product_stats(ev: str, end: str) -> str:
    return f"""SELECT l.product_id, l.price AS p_price, l.category_id AS p_category, l.brand AS p_brand, p_events_1d, p_events_7d, p_carts_7d, p_purchases_7d
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY event_time DESC, seq DESC) AS rn FROM {ev} WHERE event_time < TIMESTAMP '{end}') l
  LEFT JOIN (SELECT product_id, count(*) FILTER (WHERE event_time >= TIMESTAMP '{end}' - INTERVAL 1 DAY) AS p_events_1d, count(*) AS p_events_7d,
      count(*) FILTER (WHERE event_type = 1) AS p_carts_7d, count(*) FILTER (WHERE event_type = 2) AS p_purchases_7d
    FROM {ev} WHERE event_time < TIMESTAMP '{end}' AND event_time >= TIMESTAMP '{end}' - INTERVAL 7 DAY GROUP BY product_id) a USING (product_id) WHERE l.rn = 1"""


def _features() -> str:
    sums = ", ".join(f"coalesce(sum(part) FILTER (WHERE kind = '{k}'{extra}), 0) AS c_{k}_{t}" for k in ("time", "type", "buy2buy") for t, extra in (("all", ""), ("last", " AND h_rank = 0")))
    scores = [f"c_{k}_{t}" for k in ("time", "type", "buy2buy") for t in ("all", "last")]
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*scores, "c_sum"])
    return f"""SELECT c.session, c.product_id, CAST(c.product_id = p.target AS INT) AS label, {zero}, CAST(i.h_events IS NOT NULL AS INT) AS in_history, i.h_events, i.h_rank,
    epoch_us(p.cut_time) // 1000000 - epoch_us(i.h_last) // 1000000 AS h_seconds, i.h_max_type, s.p_events_1d, s.p_events_7d, s.p_carts_7d, s.p_purchases_7d, s.p_price,
    (s.p_price / l.price)::FLOAT AS price_ratio, CAST(s.p_category = l.category_id AS INT) AS same_category, CAST(s.p_brand = l.brand AS INT) AS same_brand, e.s_events, e.s_products,
    epoch_us(p.cut_time) // 1000000 - epoch_us(e.s_start) // 1000000 AS s_seconds, l.event_type AS l_type
  FROM (SELECT session, product_id FROM (SELECT x.*, row_number() OVER (PARTITION BY x.session ORDER BY round(c_sum, 9) DESC, x.product_id) AS rk FROM cb_six x JOIN cb_pick p ON p.session = x.session AND p.last_product <> x.product_id) WHERE rk <= 40
    UNION SELECT i.session, i.product_id FROM cb_items i JOIN cb_pick p ON p.session = i.session AND p.last_product <> i.product_id) c
  LEFT JOIN cb_six USING (session, product_id) LEFT JOIN cb_items i USING (session, product_id) LEFT JOIN stats_b s USING (product_id) JOIN cb_pick p USING (session)
  JOIN (SELECT session, count(*) AS s_events, count(DISTINCT product_id) AS s_products, min(event_time) AS s_start FROM cb_hist GROUP BY session) e USING (session)
  JOIN (SELECT h.* FROM cb_hist h JOIN cb_pick q ON q.session = h.session AND q.cut_pos = h.pos) l USING (session)""", f"SELECT *, c_time_all + c_type_all + c_buy2buy_all AS c_sum FROM (SELECT session, product_id, {sums} FROM part_b GROUP BY ALL)"


def _upper(x: str) -> str:
    """The normal distribution's upper tail at x >= 0, to 7.5e-8 (Abramowitz and Stegun, 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * ({x})))"
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"


class CDF:
    """p-value and power as SQL of an effect's distance from 0 in errors."""

    Z, REACH = "1.959963984540054", "2.8015852181129683"

    @staticmethod
    def p(d: str) -> str:
        return f"2 * {_upper(f'abs({d})')}"

    @classmethod
    def power(cls, d: str) -> str:
        low, high = f"({cls.Z} - abs({d}))", f"({cls.Z} + abs({d}))"
        return f"(CASE WHEN {low} >= 0 THEN {_upper(f'abs({low})')} ELSE 1 - {_upper(f'abs({low})')} END + {_upper(high)})"


def _drafted(a: str, b: str) -> str:
    """session, target, items and team of the team draft of two lists."""
    left = "list_filter({0}, lambda x: x >= 0 AND NOT list_contains(items, x))[1]"
    return f"""SELECT session, target, arg_max(items, i) AS items, arg_max(team, i) AS team FROM (WITH RECURSIVE d AS (
      SELECT x.session, x.run AS a, y.run AS b, target, sha256('0:' || x.session) AS h, []::BIGINT[] AS items, []::INT[] AS team, 0 AS pa, 0 AS pb, 0 AS i FROM {a} x JOIN {b} y USING (session) JOIN cb_pick USING (session)
      UNION ALL SELECT session, a, b, target, h, list_append(items, CASE WHEN side = 1 THEN na ELSE nb END), list_append(team, side), pa + CASE WHEN side = 1 THEN 1 ELSE 0 END, pb + CASE WHEN side = 1 THEN 0 ELSE 1 END, i + 1
      FROM (SELECT *, CASE WHEN na IS NULL THEN -1 WHEN nb IS NULL THEN 1 WHEN pa <> pb THEN CASE WHEN pa < pb THEN 1 ELSE -1 END WHEN (strpos('0123456789abcdef', substr(h, 64 - i // 4, 1)) - 1) >> (i % 4) & 1 = 1 THEN 1 ELSE -1 END AS side
        FROM (SELECT *, {left.format('a')} AS na, {left.format('b')} AS nb FROM d WHERE i < 20) WHERE na IS NOT NULL OR nb IS NOT NULL)) SELECT * FROM d) GROUP BY session, target"""


#: Credit of each session: of the treatment's list against the control's, and of the control's against itself.
DRAFT = "coalesce(team[list_position(items, target)], 0)"
_FEATURES, _SIX = _features()
_ALL = "UNION ALL".join(f" SELECT '{n}' AS model, * FROM run_{n} " for n in ("popular", "history", "item2item", "covis"))
CTES: dict[str, str] = {
    "day_ev": _adapter("user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"),
    "long_ev": _adapter("user_id"),
    "cust_ev": """SELECT o_custkey AS session, o_orderdate AS event_time, 0::BIGINT AS seq, o_custkey AS user_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS event_type,
    l_partkey AS product_id, p_type AS category_id, p_brand AS brand, p_retailprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "long_prep": _prepared("long_ev"), "cust_prep": _prepared("cust_ev"), "day_prep": _prepared("day_ev", "event_time < TIMESTAMP '2024-01-17'"), "night_prep": _prepared("day_ev", "event_time < TIMESTAMP '2024-01-24'"),
    "long_w": _weights("long_prep"), "cust_w": _weights("cust_prep"), "day_w": _weights("day_prep"), "night_w": _weights("night_prep"),
    "long_m": _matrix("long_w"), "cust_m": _matrix("cust_w"), "day_m": _matrix("day_w"), "night_m": _matrix("night_w"),
    **_cases("day_ev", "2024-01-17", "2024-01-24", "cb"), **_cases("day_ev", "2024-01-24", "2024-02-01", "cc"),
    "pop_b": "SELECT product_id, count(*) AS pop FROM day_ev WHERE event_time < TIMESTAMP '2024-01-17' AND event_time >= TIMESTAMP '2024-01-10' GROUP BY product_id",
    "part_b": _scores("cb_items", "day_m"),
    "six_empty": "SELECT session, product_id, 0.0::DOUBLE AS score FROM cb_items WHERE FALSE",
    "sc_history": "SELECT session, product_id, (-h_rank)::DOUBLE AS score FROM cb_items",
    "sc_item2item": "SELECT session, product_id, round(sum(part), 9) AS score FROM part_b WHERE h_rank = 0 GROUP BY ALL",
    "sc_covis": "SELECT session, product_id, round(sum(part), 9) AS score FROM part_b GROUP BY ALL",
    "run_popular": _top("six_empty", "cb_pick", "pop_b"), "run_history": _top("sc_history", "cb_pick", "pop_b"), "run_item2item": _top("sc_item2item", "cb_pick", "pop_b"), "run_covis": _top("sc_covis", "cb_pick", "pop_b"),
    "all_runs": _ALL,
    "stats_b": product_stats("day_ev", "2024-01-17"),
    "cb_six": _SIX, "feat_b": _FEATURES,
    "sess_b": """SELECT h.session, h.user_id, CAST((epoch_us(h.event_time) // 1000000 - epoch_us(TIMESTAMP '2024-01-17') // 1000000) // 86400 AS INT) AS day FROM cb_hist h WHERE h.pos = 0""",
    "hits_b": """SELECT session, CASE WHEN list_position(r.run, p.target) > 0 THEN 1 ELSE 0 END AS hit, CASE WHEN list_position(t.run, p.target) > 0 THEN 1 ELSE 0 END AS hit_t
    FROM run_item2item r JOIN run_covis t USING (session) JOIN cb_pick p USING (session)""",
    "per_user": """SELECT user_id, count(*) AS n, sum(hit)::BIGINT AS y, sum(hit_t)::BIGINT AS yt FROM sess_b JOIN hits_b USING (session) GROUP BY user_id""",
    "arm_users": """SELECT user_id, n, CASE WHEN arm = 1 THEN yt ELSE y END AS y, arm FROM (SELECT *, CASE WHEN bucket < 0.5 THEN 1 ELSE 0 END AS arm FROM (
    SELECT *, (('0x' || sha256('ranker-vs-item2item:' || user_id)[1:14])::BIGINT >> 3)::DOUBLE / 9007199254740992 AS bucket FROM per_user))""",
    "night_sc": "SELECT session, product_id FROM (" + _scores("cb_items", "night_m") + ") GROUP BY ALL",
    "draft_b": _drafted("run_covis", "run_item2item"), "draft_aa": _drafted("run_item2item", "run_item2item"),
    "shown_b": """SELECT session, q AS share FROM (SELECT session, row_number() OVER (ORDER BY sha256('0:' || session), session) - 1 AS place, count(*) OVER () AS n FROM cb_sess),
    (SELECT unnest([1.0, 0.5, 0.2, 0.1, 0.05]::DOUBLE[]) AS q) WHERE place < round(q * n)""",
    "sess_q": f"""SELECT s.session, user_id, day, q.share, hit, CASE WHEN h.session IS NOT NULL THEN hit_t ELSE hit END AS t, CASE WHEN h.session IS NOT NULL THEN x.credit ELSE y.credit END AS i
    FROM sess_b s JOIN hits_b USING (session) JOIN (SELECT session, {DRAFT} AS credit FROM draft_b) x USING (session) JOIN (SELECT session, {DRAFT} AS credit FROM draft_aa) y USING (session)
    CROSS JOIN (SELECT unnest([1.0, 0.5, 0.2, 0.1, 0.05]::DOUBLE[]) AS share) q LEFT JOIN shown_b h ON h.session = s.session AND h.share = q.share""",
    "panel_q": """SELECT user_id, share, d AS day, count(*) AS n, sum(hit)::BIGINT AS c, sum(t)::BIGINT AS t, sum(i)::BIGINT AS i,
      CASE WHEN (('0x' || sha256('ranker-vs-item2item:' || user_id)[1:14])::BIGINT >> 3)::DOUBLE / 9007199254740992 < 0.5 THEN 1 ELSE 0 END AS arm
    FROM sess_q JOIN (SELECT unnest(range(7))::INT AS d) ON day <= d GROUP BY user_id, share, d""",
    "arm_q": """SELECT *, (yy - 2 * r * yn + r * r * nn) / (sn::DOUBLE * sn) * n / (n - 1) AS v FROM (SELECT share, day, arm, count(*) AS n, sum(n)::BIGINT AS sn, sum(n * n)::BIGINT AS nn, sum(y * y)::BIGINT AS yy, sum(y * n)::BIGINT AS yn, sum(y)::DOUBLE / sum(n) AS r
      FROM (SELECT *, CASE WHEN arm = 1 THEN t ELSE c END AS y FROM panel_q) GROUP BY share, day, arm)""",
    "all_q": """SELECT share, day, n, sn, rt - rc AS effect, sqrt(4 * (cc - 2 * rc * cn + rc * rc * nn) / (sn::DOUBLE * sn) * n / (n - 1)) AS se, ri AS pref, sqrt((ii - 2 * ri * inn + ri * ri * nn) / (sn::DOUBLE * sn) * n / (n - 1)) AS pref_se FROM (
      SELECT share, day, count(*) AS n, sum(n)::BIGINT AS sn, sum(n * n)::BIGINT AS nn, sum(c * c)::BIGINT AS cc, sum(c * n)::BIGINT AS cn, sum(i * i)::BIGINT AS ii, sum(i * n)::BIGINT AS inn,
        sum(c)::DOUBLE / sum(n) AS rc, sum(t)::DOUBLE / sum(n) AS rt, sum(i)::DOUBLE / sum(n) AS ri FROM panel_q GROUP BY share, day)""",
    "arm_sums": "SELECT arm, count(*) AS n, sum(y * y)::BIGINT AS YY, sum(y * n)::BIGINT AS YN, sum(n * n)::BIGINT AS NN, sum(n)::BIGINT AS SN, sum(y)::BIGINT AS SY FROM arm_users GROUP BY arm",
}


def refresh(p: str, before: str, until: str, day: str) -> str:
    """Metrics of item to item on window C's cases of one day, with tables of the events before another."""
    CTES[f"{p}_prep"], CTES[f"{p}_w"], CTES[f"{p}_m"] = _prepared("day_ev", before), _weights(f"{p}_prep"), _matrix(f"{p}_w")
    CTES[f"{p}_pick"] = f"SELECT * FROM cc_pick WHERE cut_time >= TIMESTAMP '{day}' AND cut_time < TIMESTAMP '{day}' + INTERVAL 1 DAY"
    CTES[f"{p}_pop"] = f"SELECT product_id, count(*) AS pop FROM day_ev WHERE {before} AND event_time >= TIMESTAMP '{until}' - INTERVAL 7 DAY GROUP BY product_id"
    CTES[f"{p}_part"] = _scores("cc_items", f"{p}_m")
    CTES[f"{p}_sc"] = f"SELECT session, product_id, round(sum(part), 9) AS score FROM {p}_part WHERE h_rank = 0 GROUP BY ALL"
    CTES[f"{p}_run"] = _top(f"{p}_sc", f"{p}_pick", f"{p}_pop")
    return metrics(f"{p}_run", f"{p}_pick")


def sql(body: str) -> str:
    """body with the table expressions that it needs before it."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                need[name] = None

    visit(body)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    return f"WITH {head}\n{body}" if head else body
