"""Shared sub-queries of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

# Each entry is (names it reads, text). Order matters: later entries read earlier ones.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "profiles": (
        (),
        """
        SELECT c_custkey AS driver_id, first_day AS signup_date,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'UberX,Premier'
                                 WHEN 'MACHINERY' THEN 'UberX,uberblack'
                                 ELSE 'UberX,Comfort' END AS vehicle_dispatchability,
               4.0::DOUBLE + (c_custkey % 11) / 10.0::DOUBLE AS avg_rating,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Diamond' WHEN 'BUILDING' THEN 'Platinum'
                                 WHEN 'FURNITURE' THEN 'Gold' WHEN 'HOUSEHOLD' THEN 'Blue'
                                 ELSE 'Unknown' END AS current_tier,
               CASE WHEN last_order < (SELECT max(o_orderdate) FROM orders) - INTERVAL 270 DAY
                    THEN 1 ELSE 0 END AS "Churned"
        FROM customer
        LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day,
                          max(o_orderdate) AS last_order
                   FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
        """,
    ),
    "sessions": (
        (),
        """
        SELECT o_orderkey AS session_id, o_custkey AS driver_id,
               o_orderdate + to_seconds((o_orderkey * 6007) % 86400) AS session_start,
               o_orderdate + to_seconds((o_orderkey * 6007) % 86400
                                        + (1 + o_orderkey % 12) * 1800) AS session_end
        FROM orders
        """,
    ),
    "trips": (
        (),
        """
        SELECT l_orderkey * 10 + l_linenumber AS trip_id, o_custkey AS driver_id,
               l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 3571) % 86400)
                 AS request_time,
               CAST(l_quantity * 60 AS BIGINT) AS trip_duration_seconds,
               CAST(l_extendedprice AS DECIMAL(18, 2)) AS fare,
               CAST(floor(l_extendedprice * l_tax * 100) / 100 AS DECIMAL(18, 2)) AS tip,
               1.0::DOUBLE + l_discount * 10 AS surge_multiplier,
               CASE p_type WHEN 'PROMO' THEN 'UberBlack' WHEN 'LARGE' THEN 'Premier'
                           WHEN 'STANDARD' THEN 'Comfort' WHEN 'SMALL' THEN 'Electric'
                           ELSE 'UberX' END AS trip_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        """,
    ),
    "incentives": (
        (),
        """
        SELECT o_orderkey AS incentive_id, o_custkey AS driver_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Quest' ELSE 'Boost' END
                 AS incentive_type,
               CAST(o_orderdate AS DATE) AS offer_date,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                                  WHEN 'P' THEN 'expired' END AS status,
               CAST(floor(o_totalprice) / 100 AS DECIMAL(18, 2)) AS bonus_amount
        FROM orders
        """,
    ),
    "interactions": (
        (),
        """
        SELECT event_id, user_id AS driver_id, ts AS event_timestamp,
               CASE event_type WHEN 'click' THEN 'trip_accepted' WHEN 'error' THEN 'trip_cancelled'
                               WHEN 'purchase' THEN 'trip_ignored' WHEN 'view' THEN 'app_open'
                               WHEN 'signup' THEN 'heatmap_view' END AS event_type
        FROM events
        """,
    ),
    "online": (
        ("sessions",),
        """
        SELECT driver_id, CAST(count(*) AS BIGINT) AS session_count,
               CAST(sum(date_diff('second', session_start, session_end)) AS BIGINT) AS online_seconds
        FROM sessions GROUP BY driver_id
        """,
    ),
    "rides": (
        ("trips",),
        """
        SELECT driver_id, CAST(sum(fare + tip) AS DOUBLE) AS earned,
               CAST(sum(fare) AS DOUBLE) AS fares, CAST(sum(tip) AS DOUBLE) AS tips,
               CAST(sum(trip_duration_seconds) AS BIGINT) AS trip_seconds,
               sum(fare::DOUBLE - fare::DOUBLE / surge_multiplier) AS premium_part,
               sum(fare::DOUBLE / surge_multiplier) AS base_part,
               CAST(count(trip_id) AS BIGINT) AS n,
               CAST(count(*) FILTER (trip_type IN ('UberBlack', 'Premier')) AS BIGINT) AS n_premium,
               CAST(count(*) FILTER (
                 CASE dayofweek(lt)
                   WHEN 0 THEN hour(lt) IN (0, 1, 2, 11, 12, 13, 22, 23)
                   WHEN 6 THEN hour(lt) IN (0, 1, 2, 22, 23)
                   WHEN 5 THEN hour(lt) IN (7, 8) OR hour(lt) >= 16
                   ELSE hour(lt) IN (7, 8, 9, 16, 17, 18) END) AS BIGINT) AS n_peak
        FROM (SELECT *, request_time AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS lt
              FROM trips)
        GROUP BY driver_id
        """,
    ),
    "rhythm": (
        ("sessions",),
        """
        SELECT driver_id, coalesce(stddev_samp(gap), 0)::DOUBLE AS session_regularity,
               CAST(count(*) AS BIGINT) AS session_count
        FROM (SELECT driver_id,
                     date_diff('hour', lag(session_end) OVER (
                       PARTITION BY driver_id ORDER BY session_start, session_id), session_start) AS gap
              FROM sessions)
        GROUP BY driver_id
        """,
    ),
    "offers": (
        ("incentives",),
        """
        SELECT driver_id,
               CAST(count(*) FILTER (incentive_type = 'Quest') AS BIGINT) AS quests,
               CAST(count(*) FILTER (incentive_type = 'Quest' AND status = 'completed') AS BIGINT)
                 AS quests_done
        FROM incentives GROUP BY driver_id
        """,
    ),
    "bonuses": (
        ("incentives",),
        """
        SELECT driver_id, CAST(sum(bonus_amount) AS DOUBLE) AS bonus
        FROM incentives WHERE status = 'completed' GROUP BY driver_id
        """,
    ),
    "reactions": (
        ("interactions",),
        """
        SELECT driver_id,
               count(*) FILTER (event_type = 'trip_accepted')::DOUBLE AS yes,
               count(*) FILTER (event_type = 'trip_cancelled')::DOUBLE AS bailed,
               count(*) FILTER (event_type = 'trip_ignored')::DOUBLE AS no
        FROM interactions GROUP BY driver_id
        """,
    ),
    "features": (
        ("profiles", "online", "rides", "rhythm", "offers", "bonuses", "reactions"),
        """
        SELECT p.driver_id, signup_date, avg_rating, current_tier, "Churned",
               coalesce(earned, 0) / nullif(online_seconds / 3600.0::DOUBLE, 0)
                 AS avg_earnings_per_hour_online,
               CASE WHEN o.driver_id IS NOT NULL THEN
                 least(coalesce(trip_seconds, 0)::DOUBLE / nullif(online_seconds, 0), 1.0::DOUBLE) END
                 AS trip_utilization_rate,
               premium_part / nullif(base_part, 0) AS surge_reliance_score,
               CASE WHEN vehicle_dispatchability ILIKE '%premier%'
                      OR vehicle_dispatchability ILIKE '%uberblack%' THEN 1 ELSE 0 END
                 AS is_premium_capable,
               coalesce(n_premium::DOUBLE / nullif(n, 0), 0.0::DOUBLE) AS premium_trip_ratio,
               n_peak::DOUBLE / nullif(n, 0) AS peak_hour_driver_score,
               session_regularity,
               quests_done::DOUBLE / nullif(quests, 0) AS quest_completion_rate,
               CASE WHEN b.driver_id IS NOT NULL OR r.driver_id IS NOT NULL THEN
                 coalesce(bonus, 0) / nullif(coalesce(bonus, 0) + coalesce(fares, 0)
                                             + coalesce(tips, 0), 0) END AS incentive_reliance_pct,
               CASE current_tier WHEN 'Diamond' THEN 4 WHEN 'Platinum' THEN 3 WHEN 'Gold' THEN 2
                                 ELSE 1 END AS pro_tier_rank,
               bailed / nullif(yes + bailed, 0) AS cancellation_rate,
               yes / nullif(yes + no, 0) AS acceptance_rate,
               o.session_count
        FROM profiles p
        LEFT JOIN online o USING (driver_id) LEFT JOIN rides r USING (driver_id)
        LEFT JOIN rhythm h USING (driver_id) LEFT JOIN offers q USING (driver_id)
        LEFT JOIN bonuses b USING (driver_id) LEFT JOIN reactions x USING (driver_id)
        """,
    ),
}


def rounded(expression: str, places: int) -> str:
    """Half-even rounding by scaling, the same float steps as on the Spark side."""
    scale = 10**places
    return f"round_even(({expression}) * {scale}::DOUBLE, 0) / {scale}::DOUBLE"


def sql(body: str, *needs: str, extra: dict[str, str] | None = None, once: bool = False) -> str:
    """``body`` prefixed by the shared sub-queries it needs, then by ``extra`` ones; ``once``
    keeps every sub-query's rows instead of running it for each reader."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        wanted.add(name)

    for name in needs:
        add(name)
    how = "AS MATERIALIZED" if once else "AS"
    ctes = [f"{name} {how} ({PARTS[name][1]})" for name in PARTS if name in wanted]
    ctes += [f"{name} {how} ({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
