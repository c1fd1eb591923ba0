"""skein: retrieval, knowledge analytics and corpus preparation on DataFrames."""
