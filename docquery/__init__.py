"""docquery: document retrieval and conversation analytics as Spark DataFrame plans.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame;
nothing is collected to the driver.
"""

from docquery.config import RetrievalConfig

__all__ = ["RetrievalConfig"]
__version__ = "0.1.0"
