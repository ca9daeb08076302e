"""tandem — parallel-corpus processing on Spark DataFrames.

Modules:

* ``tandem.functions`` — ``Column`` functions (cleaning, tokenising, id arrays, time).
* ``tandem.operators`` — DataFrame operators: ``clean``, ``order``, ``tokens``,
  ``vocab``, ``batches``, ``lexicon``, ``evaluate``, ``epochs``.
* ``tandem.sources`` — readers/writers (``io``) and views over the test tables.
* ``tandem.plans`` — end-to-end flows and the registered query catalogue.
* ``tandem.streaming`` — the cleaning chain as an incremental stream job.
* ``tandem.session`` — session helper, shared checkpoint folder, lineage cuts,
  size-checked broadcasts.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session"]
