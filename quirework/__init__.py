"""quirework: clean, assemble and lay out large prose corpora with PySpark.

Every operator is a function ``Column -> Column`` (``quirework.functions``) or
``DataFrame -> DataFrame`` (``quirework.operators``). One section of a book is one
row, and the paragraph work happens on arrays inside that row, so cleaning a corpus
is a map-only job: nothing is exploded and shuffled only to be put together again.
"""

__version__ = "0.1.0"
