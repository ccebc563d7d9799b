"""The registered queries as SQL over the given tables, written for DuckDB."""

from __future__ import annotations

import re


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||"
        f"substr('89ab', (strpos('0123456789abcdef', substr({h},17,1))-1)%4+1, 1)||substr({h},18,3)||'-'||substr({h},21,12))"
    )


def _named(prefix: str, value: str) -> str:
    return _uuid(f"'{prefix}-'||CAST({value} AS VARCHAR)")


def _bucket(*parts: str) -> str:
    key = "||".join(f"CAST(length({p}) AS VARCHAR)||':'||{p}" for p in parts)
    return f"CAST(CAST('0x'||substr(sha256({key}),1,8) AS BIGINT) % 10000 AS INTEGER)"


def _sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1/(1+exp(-({z}))) ELSE exp({z})/(1+exp({z})) END)"


_SMOOTHED = "(({c}+1.0::DOUBLE)/({i}+20.0::DOUBLE))"
_Z = 1.95996398454


def _smoothed(i: str, c: str) -> str:
    return _SMOOTHED.format(i=i, c=c)


AS_OF = "TIMESTAMP '2024-01-29 00:00:00'"
FROM = "TIMESTAMP '2024-01-01 00:00:00'"
TRAIN_END = "TIMESTAMP '2024-01-16 00:00:00'"
VALIDATION_END = "TIMESTAMP '2024-01-22 00:00:00'"

CTES: dict[str, str] = {
    "ev": """SELECT event_id, ts, user_id, event_type, value,
        CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, event_id // 8 AS session FROM events""",
    "imp": """SELECT event_id AS impression_id, k AS ad_id, user_id, ts AS impression_ts,
        ts + to_minutes(event_id % 120) AS received_ts, CAST(round(value*100) AS BIGINT) AS cost_cents
        FROM ev WHERE event_type='view'""",
    "clk": """SELECT event_id AS click_id, user_id, ts AS click_ts, ts + to_minutes(event_id % 90) AS received_ts
        FROM ev WHERE event_type='click'""",
    "sreq": f"""SELECT {_named('request','session')} AS id, 'u'||CAST(u AS VARCHAR) AS user_id, created_at,
        CASE WHEN session%3<>0 THEN 'model' ELSE 'baseline' END AS policy,
        CASE WHEN session%3<>0 THEN 'model-'||CAST(session%2 AS VARCHAR) END AS model_version,
        'exp-'||CAST(u%5 AS VARCHAR) AS experiment_id
        FROM (SELECT session, min(ts) AS created_at, arg_min(user_id,event_id) AS u FROM ev GROUP BY 1)""",
    "sres0": f"""SELECT {_named('request','session')} AS request_id, {_named('ad','k')} AS ad_id,
        value - floor(value) AS text_relevance, CAST(floor(value*10) AS BIGINT) AS i
        FROM (SELECT session, k, arg_min(value,event_id) AS value FROM ev GROUP BY 1,2)""",
    "sres1": f"""SELECT request_id, ad_id, text_relevance, {_smoothed('i','(i//4)')} AS smoothed_ctr,
        ln(1+CAST(i AS DOUBLE)) AS log_impressions FROM sres0""",
    "sres": f"""SELECT *, {_sigmoid('(-1.0::DOUBLE+text_relevance+smoothed_ctr+0.1::DOUBLE*log_impressions)')} AS score FROM sres1""",
    "simp": f"""SELECT {_named('impression','event_id')} AS id, {_named('request','session')} AS request_id,
        {_named('ad','k')} AS ad_id, ts AS occurred_at, ts + to_minutes(event_id % 50) AS received_at
        FROM (SELECT session, k, min(event_id) AS event_id, arg_min(ts,event_id) AS ts FROM ev
              WHERE event_type='view' GROUP BY 1,2)""",
    "sclk0": """SELECT e.*, s.shown FROM ev e JOIN
        (SELECT session, min(event_id) AS shown FROM ev WHERE event_type='view' GROUP BY 1) s USING (session)
        WHERE e.event_type='click'""",
    "sclk": f"""SELECT {_named('click','event_id')} AS id, {_named('impression','shown')} AS impression_id,
        ts AS occurred_at, ts + to_minutes(event_id % 50) AS received_at FROM sclk0""",
    "labelled": f"""SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM sclk c WHERE c.impression_id=i.id
            AND c.received_at<={AS_OF} AND c.occurred_at>=i.occurred_at
            AND c.occurred_at<i.occurred_at+INTERVAL 24 HOURS) THEN 1 ELSE 0 END AS label
        FROM simp i WHERE i.received_at<={AS_OF} AND i.occurred_at+INTERVAL 25 HOURS<={AS_OF}""",
    "examples": """SELECT l.id AS "impressionId", l.request_id AS "requestId", l.ad_id AS "adId",
        r.created_at AS "predictionTime", l.occurred_at AS "impressionTime",
        l.occurred_at + INTERVAL 25 HOURS AS "labelAvailableAt", 'click-v1' AS "schemaVersion",
        s.text_relevance AS "textRelevance", s.smoothed_ctr AS "smoothedCtr",
        s.log_impressions AS "logImpressions", CAST(l.label AS DOUBLE) AS label
        FROM labelled l JOIN sreq r ON r.id=l.request_id
        JOIN sres s ON s.request_id=l.request_id AND s.ad_id=l.ad_id""",
    "split": f"""SELECT *, CASE
        WHEN "predictionTime"<{TRAIN_END} AND "labelAvailableAt"<={TRAIN_END} THEN 'train'
        WHEN "predictionTime">={TRAIN_END} AND "predictionTime"<{VALIDATION_END} AND "labelAvailableAt"<={VALIDATION_END} THEN 'validation'
        WHEN "predictionTime">={VALIDATION_END} AND "labelAvailableAt"<={AS_OF} THEN 'test' ELSE 'purged' END AS split
        FROM examples""",
    "scored": f"""SELECT *, {_sigmoid('(-1.0::DOUBLE+"textRelevance"+"smoothedCtr"+0.1::DOUBLE*"logImpressions")')} AS p FROM examples""",
    # The fit, restated as gradient descent on the standardised training rows for both strengths: the penalised
    # loss has one minimum, which enough fixed steps reach to well below the decimals compared.
    "tstats": """SELECT avg("textRelevance") AS m0, avg("smoothedCtr") AS m1, avg("logImpressions") AS m2,
        stddev_samp("textRelevance") AS s0, stddev_samp("smoothedCtr") AS s1, stddev_samp("logImpressions") AS s2,
        avg(label) AS prior FROM split WHERE split='train'""",
    "standard": """SELECT *, ("textRelevance"-m0)/s0 AS x0, ("smoothedCtr"-m1)/s1 AS x1, ("logImpressions"-m2)/s2 AS x2
        FROM split CROSS JOIN tstats""",
    "trainx": "SELECT x0, x1, x2, label AS y FROM standard WHERE split='train'",
    "fits": """WITH RECURSIVE g(step, reg, w0, w1, w2, b) AS (
          SELECT 0, reg, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) r(reg)
          UNION ALL
          SELECT step+1, reg, w0-1.5::DOUBLE*(avg((p-y)*x0)+reg*w0), w1-1.5::DOUBLE*(avg((p-y)*x1)+reg*w1),
            w2-1.5::DOUBLE*(avg((p-y)*x2)+reg*w2), b-1.5::DOUBLE*avg(p-y)
          FROM (SELECT g.*, x0, x1, x2, y, 1/(1+exp(-(w0*x0+w1*x1+w2*x2+b))) AS p FROM g CROSS JOIN trainx WHERE step<1000)
          GROUP BY step, reg, w0, w1, w2, b)
        SELECT * FROM g WHERE step=1000""",
    "trials": """SELECT reg, avg(-(label*ln(p)+(1-label)*ln(1-p))) AS loss FROM (
          SELECT reg, label, 1/(1+exp(-(w0*x0+w1*x1+w2*x2+b))) AS p FROM fits CROSS JOIN standard WHERE split='validation') GROUP BY reg""",
    "chosen": """SELECT f.* FROM fits f JOIN (SELECT arg_min(reg, (loss, reg)) AS reg FROM trials) USING (reg)""",
    "ftest": """SELECT s.*, 1/(1+exp(-(w0*x0+w1*x1+w2*x2+b))) AS p, "textRelevance"+0.25::DOUBLE*"smoothedCtr" AS baseline
        FROM standard s CROSS JOIN chosen WHERE split='test'""",
    "daily": """SELECT ad_id, CAST(impression_ts AS DATE) AS day, count(*) AS impressions, count(*) FILTER (WHERE hit) AS clicked
        FROM (SELECT i.*, EXISTS (SELECT 1 FROM clk c WHERE c.user_id=i.user_id AND c.click_ts>=i.impression_ts
              AND c.click_ts<i.impression_ts+INTERVAL 24 HOURS) AS hit FROM imp i) GROUP BY 1,2""",
    "exps": """SELECT 'exp-'||CAST(n_nationkey AS VARCHAR) AS id, 'salt-'||n_name AS salt,
        'model-'||CAST(n_regionkey AS VARCHAR) AS model_version,
        CAST(n_nationkey*7%81+10 AS INTEGER) AS treatment_percent, n_nationkey%5<>0 AS active FROM nation""",
    "assigned": f"""SELECT f.experiment_id, f.user_id, f.assigned_at,
        CASE WHEN {_bucket('f.experiment_id','e.salt','f.user_id')} < e.treatment_percent*100 THEN 'treatment' ELSE 'control' END AS arm
        FROM (SELECT experiment_id, user_id, min(created_at) AS assigned_at FROM sreq GROUP BY 1,2) f
        JOIN exps e ON e.id=f.experiment_id WHERE e.active""",
    "ads": f"""SELECT {_named('ad','p_partkey')} AS id, p_name AS title, p_type AS category FROM part""",
    "searches": f"""SELECT {_named('search','event_id')} AS id, 'u'||CAST(user_id AS VARCHAR) AS user_id, p_name AS query,
        ts AS created_at, CAST(event_id%16+5 AS INTEGER) AS "limit",
        CASE WHEN value<30 THEN 'exp-'||CAST(user_id%26 AS VARCHAR) END AS experiment_id
        FROM ev JOIN part ON p_partkey=k""",
    "models": """SELECT CASE WHEN r_regionkey=4 THEN 'retired-4' ELSE 'model-'||CAST(r_regionkey AS VARCHAR) END AS version,
        r_regionkey AS r, r_regionkey<>3 AS ok, 1.0::DOUBLE + r_regionkey*0.5::DOUBLE AS w0, r_regionkey*0.05::DOUBLE AS m1
        FROM region""",
    "deps": """SELECT CAST(r_regionkey AS BIGINT) AS revision, 'model-'||CAST(r_regionkey AS VARCHAR) AS model_version,
        CAST(r_regionkey*20+10 AS INTEGER) AS rollout_percent,
        TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(r_regionkey*6 AS INTEGER)) AS changed_at FROM region""",
    "snaps": f"""SELECT {_named('snapshot','day')} AS id, day + INTERVAL 1 DAY AS cutoff, day + INTERVAL 27 HOURS AS available_at
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM ev WHERE event_type='view')""",
    "afeat": f"""SELECT {_named('snapshot','day')} AS snapshot_id, {_named('ad','k')} AS ad_id, count(*) AS i,
        count(*) FILTER (WHERE value<30) AS c
        FROM (SELECT *, CAST(ts AS DATE) AS day FROM ev WHERE event_type='view') GROUP BY day, k""",
    "snap_at": """SELECT s.id AS request_id, arg_max(n.id, (n.cutoff, n.available_at, n.id)) AS snapshot_id,
        max(n.cutoff) AS snapshot_cutoff FROM searches s JOIN snaps n
        ON n.cutoff<=s.created_at AND n.available_at<=s.created_at GROUP BY 1""",
    "dep_at": """SELECT s.id AS request_id, arg_max(d.model_version, d.revision) AS dm, arg_max(d.rollout_percent, d.revision) AS dp
        FROM searches s JOIN deps d ON d.changed_at<=s.created_at GROUP BY 1""",
    "resolved0": f"""SELECT s.*, e.id IS NOT NULL AS has_exp, e.active,
        CASE WHEN e.active THEN CASE WHEN {_bucket('s.experiment_id','e.salt','s.user_id')} < e.treatment_percent*100
             THEN 'treatment' ELSE 'control' END END AS arm, e.model_version AS tm, d.dm, d.dp, n.snapshot_id AS sid,
        CAST((epoch_us(s.created_at)-epoch_us(n.snapshot_cutoff))//1000000 AS BIGINT) AS age
        FROM searches s LEFT JOIN exps e ON e.id=s.experiment_id LEFT JOIN dep_at d ON d.request_id=s.id
        LEFT JOIN snap_at n ON n.request_id=s.id""",
    "resolved1": f"""SELECT *, CASE WHEN experiment_id IS NOT NULL THEN CASE WHEN arm='treatment' THEN tm END
        WHEN {_bucket("'rollout'",'dm','user_id')} < dp*100 THEN dm END AS target FROM resolved0""",
    "resolved2": """SELECT r.*, m.ok, CASE WHEN experiment_id IS NOT NULL AND active IS NULL THEN 'unknown_experiment'
        WHEN age>86400 THEN 'stale_features'
        WHEN sid IS NULL AND target IS NOT NULL THEN 'missing_features'
        WHEN experiment_id IS NOT NULL AND NOT active THEN 'experiment_stopped'
        WHEN target IS NULL THEN 'baseline_selected'
        WHEN m.version IS NULL THEN 'missing_model' WHEN NOT m.ok THEN 'invalid_model' END AS fallback_reason
        FROM resolved1 r LEFT JOIN models m ON m.version=r.target""",
    "resolved": """SELECT id, user_id, query, created_at, "limit",
        CASE WHEN arm IS NOT NULL THEN experiment_id END AS experiment_id, arm, target AS target_model,
        CASE WHEN age<=86400 THEN sid END AS snapshot_id, age AS snapshot_age_seconds,
        CASE WHEN fallback_reason='unknown_experiment' THEN NULL WHEN fallback_reason IS NULL THEN 'model' ELSE 'baseline' END AS policy,
        CASE WHEN fallback_reason IS NULL THEN target END AS model_version, fallback_reason FROM resolved2""",
    "toks": """SELECT id AS ad_id, unnest(string_split_regex(lower(title||' '||category),'[^\\p{L}\\p{N}]+')) AS token FROM ads""",
    "tf": """SELECT token, ad_id, count(*) AS tf FROM toks WHERE token<>'' GROUP BY 1,2""",
    "asked": """SELECT DISTINCT query FROM (SELECT p_name AS query FROM part UNION ALL SELECT p_name||' '||p_type FROM part
        UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name||' unheard' FROM part)""",
    "qtok": """SELECT DISTINCT query, unnest(string_split_regex(lower(query),'[^\\p{L}\\p{N}]+')) AS token FROM asked""",
    "cand": """SELECT query, ad_id, relevance, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, ad_id) AS rank FROM (
            SELECT q.query, t.ad_id, (0.1::DOUBLE*min(t.tf))/(1+0.1::DOUBLE*min(t.tf)) AS relevance
            FROM qtok q JOIN tf t USING (token) JOIN (SELECT query, count(*) AS n FROM qtok GROUP BY 1) k USING (query)
            GROUP BY q.query, t.ad_id, k.n HAVING count(*)=k.n)) WHERE rank<=200""",
    "pairs": f"""SELECT r.id AS request_id, r."limit" AS lim, r.policy, r.model_version, c.ad_id, c.relevance AS x0,
        {_smoothed('coalesce(f.i,0)','coalesce(f.c,0)')} AS x1, ln(1+CAST(coalesce(f.i,0) AS DOUBLE)) AS x2, f.i IS NULL AS cold
        FROM resolved r JOIN cand c ON c.query=r.query
        LEFT JOIN afeat f ON f.snapshot_id=r.snapshot_id AND f.ad_id=c.ad_id WHERE r.policy IS NOT NULL""",
    "pscored": f"""SELECT p.*, CASE WHEN p.model_version IS NULL THEN x0+0.25::DOUBLE*x1 ELSE
        {_sigmoid('(-1.0::DOUBLE + m.w0*((x0-0.0)/1.0) + 2.0::DOUBLE*((x1-m.m1)/1.0) + 0.1::DOUBLE*((x2-0.0)/2.0))')} END AS score
        FROM pairs p LEFT JOIN models m ON m.version=p.model_version""",
    "ranked": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ad_id) AS INTEGER) AS position
        FROM pscored) WHERE position<=lim""",
    "pit_pred": "SELECT event_id AS prediction_id, user_id, ts AS prediction_ts FROM ev WHERE event_type='view'",
    "pit_feat": """SELECT event_id AS feature_record_id, user_id, ts AS event_ts, ts + to_days(CAST(event_id%5 AS INTEGER)) AS available_ts,
        value AS feature_value FROM ev WHERE event_type='purchase'""",
    "first_signup": f"""SELECT user_id, assigned_ts, CASE WHEN {_bucket("'signup'","'v1'",'CAST(user_id AS VARCHAR)')}<5000 THEN 'treatment' ELSE 'control' END AS arm
        FROM (SELECT user_id, min(ts) AS assigned_ts FROM ev WHERE event_type='signup' GROUP BY 1)""",
    # deliveries
    "ibase": """SELECT e.*, l.last_k, ts + to_minutes(event_id % 75) AS received FROM ev e JOIN
        (SELECT session, max(k) AS last_k FROM ev GROUP BY 1) l USING (session) WHERE event_type='view'""",
}


def _variant(n, low, high, prefix="impression", ad="k", late=0, occurred=None) -> str:
    received = f"received + to_minutes({late})"
    occ = "ts" if occurred is None else f"{received} + to_minutes({occurred})"
    where = "" if n == 0 else f" WHERE value>={low} AND value<{high}"
    return (
        f"SELECT event_id*10+{n} AS delivery_id, {_named(prefix,'event_id')} AS id, {_named('request','session')} AS request_id, "
        f"{_named('ad',ad)} AS ad_id, {occ} AS occurred_at, {received} AS received_at FROM ibase{where}"
    )


CTES["ideliv"] = " UNION ALL ".join(
    [
        _variant(0, 0, 0),
        _variant(1, 0, 10, late=120),
        _variant(2, 10, 20, ad="(k+1)", late=1),
        _variant(3, 20, 40, prefix="again", late=2),
        _variant(4, 20, 40, prefix="again", ad="last_k", late=3),
        _variant(5, 40, 45, prefix="future", occurred=1),
    ]
)
CTES["ichecked"] = """SELECT d.*, CASE
    WHEN d.occurred_at>d.received_at OR d.occurred_at<d.received_at-INTERVAL 1 HOUR THEN 'clock'
    WHEN r.created_at IS NULL THEN 'result_not_found'
    WHEN d.occurred_at<r.created_at OR d.occurred_at>=r.created_at+INTERVAL 1 HOUR THEN 'exposure_window' END AS problem
    FROM ideliv d LEFT JOIN (SELECT s.request_id, s.ad_id, q.created_at FROM sres0 s JOIN sreq q ON q.id=s.request_id) r
    ON r.request_id=d.request_id AND r.ad_id=d.ad_id"""
CTES["e0"] = """SELECT id, request_id, ad_id, occurred_at, min((received_at, delivery_id)) AS seen_at FROM ichecked
    WHERE problem IS NULL GROUP BY 1,2,3,4"""
# Rounds until nothing is left, however many: each row says when its edge was taken, or that it is open. An
# edge is taken once no earlier open edge shares its id or exposure, and blocked once a taken one does.
CTES["istored"] = """WITH RECURSIVE n AS (
      SELECT *, row_number() OVER (ORDER BY seen_at) AS k FROM e0),
    conflicts AS (
      SELECT a.k AS k, b.k AS earlier FROM n a JOIN n b ON a.id=b.id AND b.k<a.k
      UNION SELECT a.k, b.k FROM n a JOIN n b ON a.request_id=b.request_id AND a.ad_id=b.ad_id AND b.k<a.k),
    state(round, k, state) AS (
      SELECT 0, k, CASE WHEN k IN (SELECT k FROM conflicts) THEN 'open' ELSE 'taken' END FROM n
      UNION ALL
      SELECT s.round+1, s.k, CASE
          WHEN s.state<>'open' THEN s.state
          WHEN EXISTS (SELECT 1 FROM conflicts c JOIN state t ON t.k=c.earlier WHERE c.k=s.k AND t.state='taken') THEN 'blocked'
          WHEN NOT EXISTS (SELECT 1 FROM conflicts c JOIN state t ON t.k=c.earlier WHERE c.k=s.k AND t.state='open') THEN 'taken'
          ELSE 'open' END
      FROM state s WHERE EXISTS (SELECT 1 FROM state WHERE state='open'))
    SELECT n.* EXCLUDE (k) FROM n JOIN state USING (k)
    WHERE state='taken' AND round=(SELECT max(round) FROM state)"""
CTES["iout"] = """SELECT d.* EXCLUDE (problem),
    CASE WHEN s.seen_at=(d.received_at,d.delivery_id) THEN 'accepted'
         WHEN s.seen_at<(d.received_at,d.delivery_id) THEN
              CASE WHEN s.request_id=d.request_id AND s.ad_id=d.ad_id AND s.occurred_at=d.occurred_at THEN 'replay' ELSE 'conflict' END
         WHEN d.problem IS NOT NULL THEN 'rejected' ELSE 'conflict' END AS outcome,
    CASE WHEN s.seen_at=(d.received_at,d.delivery_id) THEN NULL
         WHEN s.seen_at<(d.received_at,d.delivery_id) THEN
              CASE WHEN s.request_id=d.request_id AND s.ad_id=d.ad_id AND s.occurred_at=d.occurred_at THEN NULL ELSE 'event_id' END
         ELSE coalesce(d.problem,'exposure') END AS reason
    FROM ichecked d LEFT JOIN istored s ON s.id=d.id"""


def _cvariant(n, low, high, earlier=0, late=0) -> str:
    where = "" if n == 0 else f" WHERE value>={low} AND value<{high}"
    return (
        f"SELECT event_id*10+{n} AS delivery_id, {_named('click','event_id')} AS id, {_named('impression','shown')} AS impression_id, "
        f"ts - to_minutes({earlier}) AS occurred_at, ts + to_minutes(event_id % 75) + to_minutes({late}) AS received_at FROM sclk0{where}"
    )


CTES["cdeliv"] = " UNION ALL ".join([_cvariant(0, 0, 0), _cvariant(1, 0, 10, late=120), _cvariant(2, 10, 20, earlier=1, late=1)])
CTES["cchecked"] = """SELECT d.*, CASE
    WHEN d.occurred_at>d.received_at OR d.occurred_at<d.received_at-INTERVAL 1 HOUR THEN 'clock'
    WHEN i.received_at IS NULL OR i.received_at>d.received_at THEN 'impression_not_arrived'
    WHEN d.occurred_at<i.occurred_at OR d.occurred_at>=i.occurred_at+INTERVAL 24 HOURS THEN 'attribution_window' END AS problem
    FROM cdeliv d LEFT JOIN (SELECT id, occurred_at, received_at FROM iout WHERE outcome='accepted') i ON i.id=d.impression_id"""
CTES["cout"] = """SELECT d.* EXCLUDE (problem),
    CASE WHEN s.seen_at=(d.received_at,d.delivery_id) THEN 'accepted'
         WHEN s.seen_at<(d.received_at,d.delivery_id) THEN
              CASE WHEN s.impression_id=d.impression_id AND s.occurred_at=d.occurred_at THEN 'replay' ELSE 'conflict' END
         WHEN d.problem='impression_not_arrived' THEN 'conflict' ELSE 'rejected' END AS outcome,
    CASE WHEN s.seen_at=(d.received_at,d.delivery_id) THEN NULL
         WHEN s.seen_at<(d.received_at,d.delivery_id) THEN
              CASE WHEN s.impression_id=d.impression_id AND s.occurred_at=d.occurred_at THEN NULL ELSE 'event_id' END
         ELSE d.problem END AS reason
    FROM cchecked d LEFT JOIN (SELECT id, min((received_at,delivery_id)) AS seen_at,
        arg_min(impression_id,(received_at,delivery_id)) AS impression_id, arg_min(occurred_at,(received_at,delivery_id)) AS occurred_at
        FROM cchecked WHERE problem IS NULL GROUP BY 1) s ON s.id=d.id"""


def with_tables(body: str) -> str:
    """Prepends the derived tables that ``body`` names, in order of need."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in CTES:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) and name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    # Every derived table is used by more than one branch somewhere; keep DuckDB from inlining them.
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in order)
    return f"WITH {head}\n{body}" if head else body
