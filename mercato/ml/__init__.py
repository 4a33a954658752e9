"""MLlib jobs (M1-M17): preprocessing pipelines, regressors and classifier
with time-aware validation, model comparison, importances, style clustering,
PCA and model persistence. Every fit runs on the executors through MLlib;
the driver only loops over grid points, folds and seeds."""
