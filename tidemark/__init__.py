"""Subscription revenue and churn analytics as Spark jobs.

``sources``    staging input, seed tables, calendar, warehouse tables
``functions``  Column expressions shared by the operators
``operators``  marts, dashboard aggregations, alerts, row security, audit
``plans``      the load job, view publishing, the query registry and its SQL twins
``streaming``  the same load run over newly arrived files
"""
