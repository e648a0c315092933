"""Capture-log analytics as plain Spark jobs.

Entry points by topic:

* ``siftlane.sources``   readers for capture, page and trace data
* ``siftlane.functions`` column expressions (URLs, predicates, bodies, text, HTML)
* ``siftlane.operators`` DataFrame -> DataFrame operators
* ``siftlane.streaming`` the same operators on Structured Streaming
* ``siftlane.sinks``     writers
* ``siftlane.plans``     ready-made queries over the driver tables
"""

import sys

from pyspark import cloudpickle

from siftlane.profiles import PROFILES, CaptureProfile, profile_of

# Python helpers travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PROFILES", "CaptureProfile", "profile_of"]
