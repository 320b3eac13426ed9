"""A SQL front end for lineage: it reads queries of many dialects and says where each output's value comes from."""
