"""custseg: customer-value segmentation on Spark.

RFMT(S) features, exact distributed quartiles, Gold/Silver/Bronze tiers,
Yeo-Johnson + standardisation, k-means (fixed k, automatic k, cross-validated
scree, nested, per segment, per cohort) and the profile tables behind the
reference's plots.  Every public function takes and returns DataFrames; only
fitted parameters (lambda, mean, sd, centroids) ever reach the driver.
"""

__version__ = "0.1.0"
