"""Solar and meter telemetry analytics on Spark.

Every public operator is a DataFrame-to-DataFrame function over all sites,
devices and days at once; see README.md for the map of modules.
"""

KEY = ["site_id", "device_name"]
