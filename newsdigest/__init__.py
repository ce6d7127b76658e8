"""newsdigest: a PySpark-native engine that turns tables of raw web pages and
search hits into daily news digests.

Every operator is a function ``DataFrame -> DataFrame`` (or a column
expression) built from Spark SQL built-ins, so Catalyst plans the work and it
runs distributed.  Sub-packages:

* ``functions``  scalar column expressions (text, urls, dates, predicates)
* ``sources``    scans: source lists, rule sets, page tables, fixture derivations
* ``operators``  relational operators (html node table, selectors, dedup, ...)
* ``plans``      end-to-end plans (daily digest, coverage report, query registry)
* ``sinks``      partitioned writers for the digest outputs
* ``streaming``  incremental digest over newly landed pages
"""

__version__ = "0.1.0"
