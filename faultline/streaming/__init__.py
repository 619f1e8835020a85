"""Online forms: hopping windows with watermarks, stateful detection and alerts, and ranking at each trigger."""
from .online import Convergence, OnlineRanking, detect_online, hopping, run_hopping, run_online, run_ranking, spot_online  # noqa: F401
