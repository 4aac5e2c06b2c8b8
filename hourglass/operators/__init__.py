"""DataFrame -> DataFrame operators.

cohort      – encounter x demographics, latest admission, ages, site semi-joins, single-valued attributes
concepts    – concept / value-set search, frequency tables, positivity flags, drug x procedure joins
conditions  – ordered-rule code classification, condition indicator matrix, prevalence
pivot       – long -> wide with a fixed value list (one conditional aggregation)
panel       – hourly panel: key spine, join policies, single-aggregation form
label       – next-hour event labels without pair generation, first observation per key
profile     – exact statistics: nulls, moments, quantiles, histograms, box plots, trim cascade
metrics     – confusion grid, report, ROC curve / AUC as DataFrame queries
models      – deterministic split, pyspark.ml logistic / GBT / GLM, sweep and grid search
"""
