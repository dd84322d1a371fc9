"""Training-data operators: formatting, counting, packing, deduplication, search, mixing.

Nothing else in the library imports this subpackage.  Executors must be able to
import it (``--py-files`` or an installed package).
"""
