import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewell.operators.rules import RuleSet  # noqa: E402
from tidewell.session import local_session  # noqa: E402

SETTINGS = {
    "candidate_pattern": "환경|안전|EHS|HSE|PSM|보건|수질",
    "rule_v2_include": r"환경|(?<![A-Za-z])(?:EHS|HSE)(?![A-Za-z])|수질|안전\s*관리|PSM",
    "rule_v2_exclude": r"대행|영업|미화|기간제|계약직|현장\s*안전관리자",
    "block_page_pattern": "Access Denied|사람인지 확인",
    "max_min_years": 7,
    "large_companies": ["한빛전자", "HB", "한빛전자소재", "NX케미칼", "3Q"],
    "mid_companies": ["누리소재", "대솔"],
    "profiles": {
        "_note": "entries that are no mapping are notes",
        "환경": {"base_rule": True, "include": r"환경|수질|(?<![A-Za-z])(?:EHS|HSE)(?![A-Za-z])", "exclude": r"근무\s*환경|개발자"},
        "안전": {"include": r"안전|PSM|(?<![A-Za-z])(?:EHS|HSE)(?![A-Za-z])", "exclude": r"대행|미화|소방|요원|기간제|계약직|식품\s*안전",
                "rescue_from": "소방", "rescue_if": r"산업\s*안전|EHS",
                "construction": "건설(?!기계)|건축", "construction_max_rank": 2, "construction_site": "현장|신축"},
    },
    "ml": {"keep_threshold": 0.1, "recommend_threshold": 0.3},
    "verify": {"max_per_run": 2, "recheck_days": 3, "retry_failed_days": 7},
}


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def rules():
    return RuleSet.from_settings(SETTINGS)


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column over rows given as dictionaries, in order."""
    def run(rows, schema, column):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).coalesce(1)
        return [r[0] for r in df.orderBy("i").select(column).collect()]

    return run
