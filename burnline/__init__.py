"""burnline: project hours, budget ledger and sprint forecasts as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions. Nothing is collected to the driver, and every
time-dependent operator takes an explicit ``as_of`` timestamp instead of
reading the wall clock.
"""

__version__ = "0.1.0"
