"""quern: a Spark-native engine for text corpora.

Scans, cleaning, corpus assembly, tokenisation, instruction building, inverted-index
retrieval, array kernels and reports, all expressed as lazy DataFrame plans.
"""

__version__ = "0.1.0"
