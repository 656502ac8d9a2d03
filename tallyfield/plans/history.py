"""Queries over team rows: past-only features, opponents, leakage, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.nulls import safe_divide
from tallyfield.operators import features as f
from tallyfield.operators import markets
from tallyfield.plans.bindings import TEAM_SQL, table, team_rows

_TEAM, _ORDER = ["user_id"], ["ts", "event_id"]
_PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _p(n) -> str:
    return _PAST.format(n)


@query(f"WITH {TEAM_SQL} SELECT event_id, " + ", ".join(f"round(avg({c}) {_p(n)}, 6) AS {c}_avg_last_{n}" for c in ("goals", "shots", "corners") for n in (3, 5, 10)) + " FROM team")
def past_mean_3_5_10(spark, d):
    spec = {f"{c}_avg_last_{n}": ("mean", c, n) for c in ("goals", "shots", "corners") for n in (3, 5, 10)}
    out = f.past_features(team_rows(spark, d), _TEAM, _ORDER, spec)
    return out.select("event_id", *[F.round(n, 6).alias(n) for n in spec])


@query(f"WITH {TEAM_SQL} SELECT event_id, CAST(sum(goals) {_p(5)} AS BIGINT) AS goals_sum_5, round(stddev_pop(goals) {_p(5)}, 6) AS goals_std_5, round(stddev_pop(shots) {_p(5)}, 6) AS shots_std_5 FROM team")
def past_sum_std(spark, d):
    out = f.past_features(team_rows(spark, d), _TEAM, _ORDER, {"goals_sum_5": ("sum", "goals", 5), "goals_std_5": ("std", "goals", 5), "shots_std_5": ("std", "shots", 5)})
    return out.select("event_id", "goals_sum_5", F.round("goals_std_5", 6).alias("goals_std_5"), F.round("shots_std_5", 6).alias("shots_std_5"))


@query(f"""WITH {TEAM_SQL}, v AS (SELECT event_id, side, round(avg(goals) OVER (PARTITION BY user_id, side ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS x FROM team)
SELECT event_id, CASE WHEN side = 'home' THEN x END AS home_goals_avg_last_5, CASE WHEN side = 'away' THEN x END AS away_goals_avg_last_5 FROM v""")
def side_scoped_mean(spark, d):
    out = f.side_mean(team_rows(spark, d), "user_id", "side", _ORDER, "goals", 5)
    return out.select("event_id", *[F.round(f"{s}_goals_avg_last_5", 6).alias(f"{s}_goals_avg_last_5") for s in ("home", "away")])


@query(f"WITH {TEAM_SQL} SELECT event_id, lag(shots + corners) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pressure_index FROM team")
def lag_pressure(spark, d):
    rows = team_rows(spark, d).withColumn("pressure_raw", F.col("shots") + F.col("corners"))
    return f.lagged(rows, _TEAM, _ORDER, "pressure_raw", "pressure_index").select("event_id", "pressure_index")


@query(f"WITH {TEAM_SQL} SELECT event_id, round(avg(goals) {_p(3)} - avg(goals) {_p(6)}, 6) AS goals_trend FROM team")
def trend_3_6(spark, d):
    return f.trend(team_rows(spark, d), _TEAM, _ORDER, "goals", "goals_trend").select("event_id", F.round("goals_trend", 6).alias("goals_trend"))


def _streak_sql(hit: str, name: str) -> str:
    return f"""WITH {TEAM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM team)
SELECT event_id, CAST(rn - 1 - coalesce(max(CASE WHEN NOT ({hit}) THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS {name} FROM n"""


@query(_streak_sql("result = 'W'", "win_streak"))
def streak_before(spark, d):
    return f.streak_before(team_rows(spark, d), _TEAM, _ORDER, F.col("result") == "W", "win_streak").select("event_id", "win_streak")


@query(_streak_sql("result <> 'L'", "unbeaten_streak"))
def unbeaten_streak(spark, d):
    return f.streak_before(team_rows(spark, d), _TEAM, _ORDER, F.col("result") != "L", "unbeaten_streak").select("event_id", "unbeaten_streak")


_LEAGUE = f"""{TEAM_SQL}, daily AS (SELECT event_type, day, avg(goals) AS g, avg(shots) AS s FROM team GROUP BY 1, 2),
league AS (SELECT event_type, day, avg(g) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS league_goals,
           avg(s) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS league_shots FROM daily)"""


@query(f"WITH {_LEAGUE} SELECT event_id, round(league_goals, 6) AS league_goals, round(league_shots, 6) AS league_shots FROM team LEFT JOIN league USING (event_type, day)")
def league_prior_avg(spark, d):
    out = f.league_past_mean(team_rows(spark, d), "event_type", "day", ["goals", "shots"])
    return out.select("event_id", F.round("league_goals", 6).alias("league_goals"), F.round("league_shots", 6).alias("league_shots"))


@query(f"""WITH {_LEAGUE}, p AS (SELECT *, avg(goals) {_p(5)} AS g5, avg(shots) {_p(5)} AS s5 FROM team), j AS (SELECT * FROM p LEFT JOIN league USING (event_type, day))
SELECT event_id, round(g5 / nullif(league_goals, 0), 6) AS goals_vs_league, round(g5 / nullif(s5, 0), 6) AS goals_per_shot,
  round(nullif(0.5 * coalesce(g5, 0) + 0.3 * coalesce(g5 / nullif(s5, 0), 0) + 0.2 * coalesce(s5 / nullif(league_shots, 0), 0), 0), 6) AS expected_goals_proxy,
  CAST(s5 > league_shots AS INTEGER) AS high_shots_flag FROM j""")
def relative_strength(spark, d):
    rows = f.past_features(team_rows(spark, d), _TEAM, _ORDER, {"g5": ("mean", "goals", 5), "s5": ("mean", "shots", 5)})
    rows = f.league_past_mean(rows, "event_type", "day", ["goals", "shots"])
    rows = f.relative(rows, {"goals_vs_league": ("g5", "league_goals"), "goals_per_shot": ("g5", "s5"), "shots_vs_league": ("s5", "league_shots")})
    proxy = f.goals_proxy(F.col("g5"), F.col("goals_per_shot"), F.col("shots_vs_league"))
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("goals_vs_league", "goals_per_shot")], F.round(proxy, 6).alias("expected_goals_proxy"), (F.col("s5") > F.col("league_shots")).cast("int").alias("high_shots_flag"))


def _matches(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.col("o_custkey").alias("home"), (F.col("o_custkey") * 7 % 1000 + 1).alias("away"), F.to_date("o_orderdate").alias("day"), (F.floor("o_totalprice") % 5).alias("hg"), (F.floor(F.col("o_totalprice") / 7) % 4).alias("ag"),
        (F.floor(F.col("o_totalprice") / 3) % 14).alias("corners"), "o_orderstatus", "o_orderpriority",
    )


_MATCH_SQL = """match AS (SELECT o_orderkey, o_custkey AS home, o_custkey * 7 % 1000 + 1 AS away, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) % 5 AS hg,
  CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS ag, CAST(floor(o_totalprice / 3) AS BIGINT) % 14 AS corners, o_orderstatus, o_orderpriority FROM orders),
side AS (SELECT o_orderkey, day, 'home' AS side, home AS team_key, away AS opponent_key, hg AS goals_for, ag AS goals_against FROM match
  UNION ALL SELECT o_orderkey, day, 'away', away, home, ag, hg FROM match)"""


def _sides(spark, d):
    return f.two_sides(_matches(spark, d), {"key": "home", "goals": "hg"}, {"key": "away", "goals": "ag"}, ["o_orderkey", "day"])


@query(f"WITH {_MATCH_SQL} SELECT o_orderkey, side, team_key, opponent_key, goals_for, goals_against FROM side")
def unpivot_two_sides(spark, d):
    return _sides(spark, d).drop("day")


@query(f"WITH {_MATCH_SQL} SELECT o_orderkey, side, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D' ELSE 'L' END AS result, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points FROM side")
def result_points(spark, d):
    r = f.result_of(F.col("goals_for"), F.col("goals_against"))
    return _sides(spark, d).select("o_orderkey", "side", r.alias("result"), f.points_of(r).alias("points"))


_DEF = "avg(goals_against) OVER (PARTITION BY team_key ORDER BY day, o_orderkey, side ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(f"WITH {_MATCH_SQL}, d AS (SELECT *, {_DEF} AS defence FROM side) SELECT a.o_orderkey, a.side, round(b.defence, 6) AS opponent_defence FROM d a LEFT JOIN d b ON a.o_orderkey = b.o_orderkey AND a.opponent_key = b.team_key AND a.side <> b.side")
def opponent_self_join(spark, d):
    rows = f.past_features(_sides(spark, d), ["team_key"], ["day", "o_orderkey", "side"], {"defence": ("mean", "goals_against", 5)})
    other = F.when(F.col("side") == "home", "away").otherwise("home")
    rows = rows.withColumn("match", F.concat_ws(":", "o_orderkey", "side")).withColumn("other_match", F.concat_ws(":", "o_orderkey", other))
    lookup = rows.select(F.col("match").alias("other_match"), F.col("defence").alias("opponent_defence"))
    return rows.join(lookup, "other_match", "left").select("o_orderkey", "side", F.round("opponent_defence", 6).alias("opponent_defence"))


@query(f"WITH {TEAM_SQL} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS first_not_null FROM team")
def leakage_check(spark, d):
    rows = f.past_features(team_rows(spark, d), _TEAM, _ORDER, {"goals_avg_last_5": ("mean", "goals", 5)})
    return f.leaks(rows, _TEAM, _ORDER, "goals_avg_last_5", "mean", "goals", 5)


@query(f"WITH {TEAM_SQL}, t AS (SELECT event_id, goals, lead(goals, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM team) SELECT * FROM t WHERE target IS NOT NULL")
def lead_targets(spark, d):
    return f.lead_targets(team_rows(spark, d).select("event_id", "user_id", "ts", "goals"), _TEAM, _ORDER, "goals", 2).select("event_id", "goals", "target")


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS test_rows FROM orders GROUP BY 1),
w AS (SELECT year, CAST(sum(test_rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS train_rows, test_rows FROM y) SELECT * FROM w WHERE train_rows IS NOT NULL""")
def walk_forward_folds(spark, d):
    return f.walk_forward_folds(table(spark, d, "orders"), "o_orderdate")


@query(f"""WITH {TEAM_SQL}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM team)
SELECT event_id, CASE WHEN rn <= floor(0.7 * c) THEN 'train' ELSE 'test' END AS part FROM n""")
def ordered_split(spark, d):
    return f.ordered_split(team_rows(spark, d), _TEAM, _ORDER, 0.7).select("event_id", "part")


@query(f"WITH {TEAM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM team) SELECT user_id, event_id, goals FROM n WHERE rn = 1")
def first_rows(spark, d):
    return markets.first_of_group(team_rows(spark, d), _TEAM, _ORDER).select("user_id", "event_id", "goals")


@query(f"WITH {TEAM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM team) SELECT user_id, event_id, goals FROM n WHERE rn <= 10")
def last_n_rows(spark, d):
    return markets.last_n(team_rows(spark, d), _TEAM, [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "goals")


@query(f"WITH {TEAM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM team), r AS (SELECT user_id, rn, goals, shots, result FROM n WHERE rn <= 10) SELECT user_id, round(avg(goals), 6) AS goals_avg_10, round(avg(CASE WHEN rn <= 5 THEN goals END), 6) AS goals_avg_5, round(avg(CAST(goals > 2.5 AS DOUBLE)), 6) AS over_25_rate, round(avg(CAST(goals = 0 AS DOUBLE)), 6) AS blank_rate, CAST(sum(CASE WHEN rn <= 5 THEN CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS form FROM r GROUP BY 1")
def future_team_rates(spark, d):
    order = [F.desc("ts"), F.desc("event_id")]
    rows = markets.last_n(team_rows(spark, d), _TEAM, order, 10)
    from pyspark.sql import Window

    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    five = F.col("rn") <= 5
    return rows.groupBy("user_id").agg(
        F.round(F.avg("goals"), 6).alias("goals_avg_10"), F.round(F.avg(F.when(five, F.col("goals"))), 6).alias("goals_avg_5"), F.round(F.avg((F.col("goals") > 2.5).cast("double")), 6).alias("over_25_rate"),
        F.round(F.avg((F.col("goals") == 0).cast("double")), 6).alias("blank_rate"), F.sum(F.when(five, f.points_of(F.col("result"))).otherwise(0)).alias("form"),
    )


@query(f"WITH {TEAM_SQL}, w AS (SELECT event_id, user_id, ts, value, value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1 AS change FROM team) SELECT event_id, round(change, 6) AS change FROM w")
def percent_change(spark, d):
    rows = f.lagged(team_rows(spark, d), _TEAM, _ORDER, "value", "before")
    return rows.select("event_id", F.round(safe_divide("value", "before") - 1, 6).alias("change"))


@query(f"""WITH {TEAM_SQL}, w AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM team), s AS (SELECT user_id, stddev_samp(diff) AS sd FROM w GROUP BY 1)
SELECT user_id, CAST(coalesce(sum(CAST(abs(diff) > 2 * sd AS BIGINT)), 0) AS BIGINT) AS spikes FROM w JOIN s USING (user_id) GROUP BY 1""")
def spike_counts(spark, d):
    from pyspark.sql import Window

    rows = f.lagged(team_rows(spark, d), _TEAM, _ORDER, "value", "before").withColumn("diff", F.col("value") - F.col("before"))
    rows = rows.withColumn("sd", F.stddev_samp("diff").over(Window.partitionBy("user_id")))
    return rows.groupBy("user_id").agg(F.coalesce(F.sum((F.abs("diff") > 2 * F.col("sd")).cast("long")), F.lit(0)).alias("spikes"))


@query(f"""WITH {TEAM_SQL}, g AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM team)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM g""")
def forward_fill(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = team_rows(spark, d).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return rows.select("event_id", F.last("v", ignorenulls=True).over(w).alias("filled"))


@query(f"WITH {_MATCH_SQL} SELECT team_key, count(*) AS played, CAST(sum(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS draws, CAST(sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(goals_for - goals_against) AS BIGINT) AS goal_difference FROM side GROUP BY 1")
def standings(spark, d):
    r = f.result_of(F.col("goals_for"), F.col("goals_against"))
    return _sides(spark, d).groupBy("team_key").agg(
        F.count("*").alias("played"), F.sum((r == "W").cast("long")).alias("wins"), F.sum((r == "D").cast("long")).alias("draws"), F.sum(f.points_of(r).cast("long")).alias("points"), F.sum(F.col("goals_for") - F.col("goals_against")).alias("goal_difference"),
    )
