"""Subject time-series analytics on Spark."""

from pulsegrid.plans.feature_frame import FeatureConfig, FeatureFrame, build_feature_frame
from pulsegrid.plans.flows import forecast, ingest, latent_exposure, prepare, research
from pulsegrid.plans.prepared import PreparedDataset, build_prepared_dataset
from pulsegrid.session import build_session

__all__ = [
    "FeatureConfig", "FeatureFrame", "PreparedDataset", "build_feature_frame", "build_prepared_dataset", "build_session",
    "forecast", "ingest", "latent_exposure", "prepare", "research",
]
