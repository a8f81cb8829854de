"""ledgerlake: public-finance analytics and training-data preparation as Spark jobs."""
