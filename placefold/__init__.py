"""placefold: business-listing analytics as Spark jobs.

Sightings of businesses, stored directory pages, crawl tasks and country
boundaries go in as DataFrames; golden listings, job statistics, spatial
splits, exports and incremental deliveries come out as DataFrames.
"""

__version__ = "0.1.0"
