"""Entity analytics on Spark: filters, folds, views, history, graphs, transactions and sync as DataFrame plans."""
