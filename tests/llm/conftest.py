import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from llm_fixtures import corpus, no_documents, odd_documents  # noqa: E402, F401
