"""Fleet-wide cleaning, checking and publishing of Modbus register maps on Spark.

One DataFrame holds the rows of many register maps, keyed by ``map_id``. Row
rules are Catalyst expressions (:mod:`regfleet.functions`); everything that
depends on the order of the rows inside a map is a skew-safe ordered scan
(:mod:`regfleet.operators.ordering`); the user-level jobs are in
:mod:`regfleet.plans`.
"""
