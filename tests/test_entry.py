import subprocess
import sys
from pathlib import Path

import __spark_entry__
from millrace import queries

ROOT = Path(__file__).parent.parent


def test_every_core_query_is_there():
    assert queries.queries().keys() <= __spark_entry__.queries().keys()
    assert queries.oracle_sql().keys() <= __spark_entry__.oracle_sql().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_a_missing_package_costs_only_what_needs_it():
    code = """if True:
        import sys, warnings
        sys.modules.update(dict.fromkeys(["ahocorasick", "regex", "xxhash", "public_tokenizers"]))
        import __spark_entry__ as e
        from millrace import queries
        with warnings.catch_warnings(record=True):
            warnings.simplefilter("always")
            assert queries.queries().keys() <= e.queries().keys()
    """
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
